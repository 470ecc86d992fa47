import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bnlake.session import get_spark
    s = get_spark(master="local[*]", partitions=8, app="bnlake-tests")
    yield s


@pytest.fixture(scope="session")
def small_spec():
    """A five-node network with a two-parent leaf."""
    from bnlake.spec import NetworkSpec, Node
    nodes = [Node("a", "a"), Node("b", "b"), Node("c", "c", ("a",)),
             Node("d", "d", ("a", "b")), Node("y", "y", ("c", "d"))]
    return NetworkSpec(nodes, target="y", tracks={"all": ["a", "b", "c", "d"], "roots": ["a", "b"]},
                       key="id", order_col="id")


def _u(*parts):
    import hashlib
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(h[:13], 16) / 2 ** 52


@pytest.fixture(scope="session")
def small_df(spark):
    """600 rows with dependence a -> c, (a, b) -> d, (c, d) -> y, a few nulls."""
    rows = []
    for i in range(600):
        a = int(_u("a", i) * 3)
        b = int(_u("b", i) * 2)
        c = a if _u("c", i) < 0.7 else int(_u("c2", i) * 3)
        d = (a + b) % 2 if _u("d", i) < 0.8 else int(_u("d2", i) * 2)
        y = (c + d) % 3 if _u("y", i) < 0.6 else int(_u("y2", i) * 3)
        rows.append((i, a, b, None if i % 97 == 0 else c, d, y))
    return spark.createDataFrame(rows, "id long, a int, b int, c int, d int, y int")
