"""Draws in numpy are those of Spark and SQL."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bnlake.functions.draws import uniforms
from bnlake.functions.scalar import seeded_uniform


def test_draws_equal_md5():
    js = np.array([0, 9, 10, 99, 100, 12345, 10 ** 9, 10 ** 15 + 7], np.int64)
    bs = np.array([0, 7, 10, 499, 3, 12, 99, 100], np.int64)
    for seed in (42, -7, "x"):
        want = [int(hashlib.md5(f"{seed}|{b}|5|{j}".encode()).hexdigest()[:13], 16) / 2 ** 52 for b, j in zip(bs, js)]
        assert uniforms(seed, bs, 5, js).tolist() == want
    assert len(uniforms(42, 1, np.arange(0))) == 0
    with pytest.raises(ValueError):
        uniforms(42, np.array([-1]))


def test_draws_equal_spark(spark):
    got = uniforms(42, np.arange(20_000) // 100, np.arange(20_000) % 137)
    rows = spark.range(20_000).select(seeded_uniform(F.lit(42), F.floor(F.col("id") / 100), F.col("id") % 137).alias("u"), "id")
    assert [r.u for r in rows.orderBy("id").collect()] == got.tolist()


def test_bootstrap_by_group_with_gaps(spark):
    """Groups that lack cases or names, and scores that are null, count as in plain sums."""
    from bnlake.operators import bootstrap
    rows = [(i, g, None if i % 5 == 0 else float(i)) for i in range(50) for g in ("a", None) if g or i < 30]
    df = spark.createDataFrame(rows, "case_id long, model string, hit double")
    u = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:13], 16) / 2 ** 52
    want = {"a": [], None: []}
    for b in range(30):
        drawn = [int(u(3, b, 0, j + 1) * 50) for j in range(50)]
        for g in want:
            want[g].append(sum(i for i in drawn if i % 5 and (g or i < 30)) / 50)
    for r in bootstrap.bootstrap_ci_by(df, ["model"], ["hit"], 30, 3).collect():
        lo, hi = np.percentile(want[r.model], [2.5, 97.5])
        assert (r.hit_lo, r.hit_hi) == pytest.approx((lo, hi))
