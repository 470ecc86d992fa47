import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"w{i}" for i in range(20, 90))
    long = " ".join(f"x{i % 3000}" for i in range(9000))
    rows = [(1, a, "s"), (2, b, "s"), (3, None, "s"), (4, "", None), (5, "one two", "s"), (5, "one two", "s"),
            (None, a, "t"), (7, long, "s"), (8, a, "s"), (None, None, None), (9, " \t\n ", "t"), (10, "é ünï " * 30, "t"),
            (11, "A b  c\nA b  c\nd e f g h i j k l", "s")]
    return spark.createDataFrame([(*r, "en", i, f"h{i}", i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, source string, lang string, n_words long, h string, key int")
