"""Text of codes and the fit's rows."""

from pyspark.sql import functions as F

from bnlake.functions.scalar import canonical
from bnlake.operators import prep


def test_canonical_text(spark):
    values = ["1", "1.0", "-2.000", "1.05", "1.0x", ".0", "10", "v1.0", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = ["1", "1", "-2", "1.05", "1.0x", ".0", "10", "v1.0", "", None]
    assert [r[0] for r in df.select(canonical(F.col("v"))).collect()] == want
    nums = spark.createDataFrame([(1.0, 10), (2.5, None)], "a double, b int")
    assert [tuple(r) for r in nums.select(canonical(F.col("a")), canonical(F.col("b"))).collect()] == [("1", "10"), ("2.5", None)]


def test_rows_with_gaps_go_before_any_text_is_made(spark, small_spec, small_df):
    """Whole numbers need no pattern; gaps are found in the columns as they are."""
    out = prep.rename_nodes(small_df, small_spec)
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.id, *map(str, (r.a, r.b, r.c, r.d, r.y))) for r in small_df.collect() if r.c is not None}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    texts = small_df.select("id", *[F.concat(F.col(c).cast("string"), F.lit(".0")).alias(c) for c in "abcdy"])
    assert {tuple(r) for r in prep.rename_nodes(texts, small_spec).collect()} == want
