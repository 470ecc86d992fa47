"""Percentile bootstrap (M8) by counts split over blocks of cases.

A replicate's n draws are first counted by the block of cases that they fall into;
within a block the draws are uniform, so each block makes its own, from an array of
its cases' scores, and only sums leave it. Cases are shuffled once, replicates as one
count and one sum a block: no draw crosses the network, and numpy makes them in runs. Draws are md5 of (seed, b, j)
for blocks and (seed, b, block, j) within one: the same numbers on any partitioning or
after a task retry, and in SQL. All metrics share the seed, so their intervals use the
same resamples.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bnlake.functions.draws import uniforms
from bnlake.functions.scalar import seeded_uniform
from bnlake.session import keep

#: Cases in a range of keys (about), and in a block of draws.
BUCKET = 1 << 16
BLOCK = 1 << 10
#: Draws that are counted at once.
RUN = 1 << 18


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Add ``idx`` = 0..n-1 in key order without a single-partition sort: ranges
    of about 65,536 rows by Spark's sampled range partitioning, written once, their
    counts summed to offsets, then a row_number inside each range. Ranges hold equal
    numbers of rows wherever the keys lie."""
    n = df.count()
    ranges = max(1, -(-n // BUCKET))
    b = keep(df.repartitionByRange(ranges, key).withColumn("_bk", F.spark_partition_id()))
    cnt = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.select("_bk", F.coalesce(F.sum("_c").over(           # a row a range: n / 65,536
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_bk").orderBy(key))
    return b.withColumn("_rn", rn).join(off, "_bk") \
            .withColumn("idx", (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_bk", "_off", "_rn")


def block_counts(spark: SparkSession, n: int, n_boot: int, seed: int) -> DataFrame:
    """(k, b, c): how many of replicate b's n draws fall into block k, if any. Each task
    draws runs of ``RUN`` numbers and returns only their counts."""
    runs, block = -(-n // RUN), BLOCK
    tasks = max(1, min(n_boot * runs, 4 * spark.sparkContext.defaultParallelism))

    def count(batches):
        for batch in batches:
            for i in batch["id"].to_numpy():
                b, start = int(i) // runs, int(i) % runs * RUN
                at = np.floor(uniforms(seed, b, np.arange(start, min(start + RUN, n))) * n).astype(np.int64)
                c = np.bincount(at // block)
                k = np.flatnonzero(c)
                yield pd.DataFrame({"b": np.full(len(k), b), "k": k, "c": c[k]})

    drawn = spark.range(0, n_boot * runs, 1, tasks).mapInPandas(count, "b long, k long, c long")
    return drawn.groupBy("k", "b").agg(F.sum("c").alias("c"))


def replicate_sums(cases: DataFrame, key: str, metrics: list[str], n_boot: int, seed: int) -> tuple[DataFrame, int]:
    """(b, g, metric...): parts of the sums of each metric over the cases that replicate b
    draws, one row a block and group, and the number of cases. ``cases`` has ``entries``:
    structs of a group number g and the metrics. No cases: no rows."""
    cases = keep(cases.select(key, "entries"))     # counted, ranged and indexed
    indexed = dense_index(cases, key)
    n, block = cases.count(), BLOCK
    blocks = indexed.select((F.col("idx") / F.lit(block)).cast("long").alias("k"), (F.col("idx") % block).cast("int").alias("place"),
                            F.inline("entries")) \
                    .groupBy("k").agg(F.collect_list(F.struct("place", "g", *[F.col(m).cast("double").alias(m) for m in metrics])).alias("h")) \
                    .select("k", *[F.col(f"h.{c}").alias(f"h{i}") for i, c in enumerate(("place", "g", *metrics))])
    shares = block_counts(cases.sparkSession, n, n_boot, seed).groupBy("k").agg(    # at most n_boot entries
        F.collect_list(F.struct("b", "c")).alias("s")).select("k", F.col("s.b").alias("b"), F.col("s.c").alias("c"))
    # little data but much work: blocks are spread by their number, not by their bytes
    held = -(-n // block)
    tasks = max(1, min(held, max(4 * cases.sparkSession.sparkContext.defaultParallelism, held // 64)))

    def draw(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                size = min(block, n - row.k * block)
                start = np.cumsum(row.c) - row.c
                which = np.repeat(np.arange(len(row.b)), row.c)
                j = np.arange(len(which)) - start[which] + 1
                place = np.floor(uniforms(seed, row.b[which], row.k, j) * size).astype(np.int64)
                times = np.bincount(which * size + place, minlength=len(row.b) * size).reshape(-1, size).astype(np.float64)
                values = np.array([np.asarray(v, np.float64) for v in row[5:]]).T
                known = ~np.isnan(values)
                values = np.where(known, values, 0.0)
                for g in np.unique(row.h1):
                    of = row.h1 == g
                    t = times[:, row.h0[of]]
                    sums = np.where(t @ known[of] > 0, t @ values[of], np.nan)     # nulls don't count
                    drawn = t.any(axis=1)
                    yield pd.DataFrame({"b": row.b[drawn], "g": np.full(drawn.sum(), g)}
                                       | {f"s{i}": pd.array(sums[drawn, i], "Float64") for i in range(len(metrics))})

    cols = ["k", "b", "c", "h0", "h1", *[f"h{i + 2}" for i in range(len(metrics))]]
    # a merge: Spark takes the drawn counts for the few rows that they were drawn from, and would broadcast them
    own = blocks.join(shares.hint("merge"), "k").repartition(tasks, "k").select(*cols)
    sums = own.mapInPandas(draw, "b long, g int, " + ", ".join(f"s{i} double" for i in range(len(metrics))))
    return sums.select("b", "g", *[F.col(f"s{i}").alias(m) for i, m in enumerate(metrics)]), n


def replicate_means(scores: DataFrame, metrics: list[str], n_boot: int = 500,
                    seed: int = 42, key: str = "case_id") -> DataFrame:
    """(b, metric...) = mean of each per-case metric over replicate b."""
    entries = F.array(F.struct(F.lit(0).alias("g"), *metrics)).alias("entries")
    sums, n = replicate_sums(scores.select(key, entries), key, metrics, n_boot, seed)
    return sums.groupBy("b").agg(*[(F.sum(m) / F.lit(float(max(n, 1)))).alias(m) for m in metrics])


def _percentiles(metrics: list[str], alpha: float) -> list:
    qs = [alpha / 2, 1 - alpha / 2]
    aggs = []
    for m in metrics:
        pc = F.percentile(F.col(m), qs)
        aggs += [pc[0].alias(f"{m}_lo"), pc[1].alias(f"{m}_hi")]
    return aggs


def bootstrap_ci(scores: DataFrame, metrics: list[str], n_boot: int = 500, seed: int = 42,
                 alpha: float = 0.05, key: str = "case_id", method: str = "exact") -> DataFrame:
    """One row: ``{m}_lo``, ``{m}_hi`` = linear-interpolated percentiles.

    ``exact`` (at every size): multinomial resampling, summed where blocks of scores
    are; ``poisson``, only when asked for: Poisson(1) case weights, summed
    map-side (only B rows per partition cross the network)."""
    rep = (replicate_means if method == "exact" else poisson_replicates)(
        scores, metrics, n_boot, seed, key)
    return rep.agg(*_percentiles(metrics, alpha))


def bootstrap_ci_by(scores: DataFrame, by: list[str], metrics: list[str], n_boot: int = 500, seed: int = 42,
                    alpha: float = 0.05, key: str = "case_id") -> DataFrame:
    """Intervals of several models over the same cases: a row for each value of ``by``.

    Every model has a score row for every case, so the models share one set of
    draws; each case's scores are packed into one row, and the draws meet them once."""
    groups = scores.select(*by).distinct().collect()                     # one row a model
    same = [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c]).cast(scores.schema[c].dataType)) for c in by]) for r in groups]
    g = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(same)], F.lit(-1))
    packed = scores.groupBy(key).agg(F.collect_list(F.struct(g.alias("g"), *metrics)).alias("entries"))   # one entry a model
    sums, n = replicate_sums(packed, key, metrics, n_boot, seed)
    rep = sums.groupBy("b", "g").agg(*[(F.sum(m) / F.lit(float(max(n, 1)))).alias(m) for m in metrics])
    names = scores.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(groups)], StructType(
        [StructField("g", IntegerType()), *[scores.schema[c] for c in by]]))
    return rep.groupBy("g").agg(*_percentiles(metrics, alpha)).join(F.broadcast(names), "g").select(
        *by, *[f"{m}_{e}" for m in metrics for e in ("lo", "hi")])


def poisson_replicates(scores: DataFrame, metrics: list[str], n_boot: int = 500,
                       seed: int = 42, key: str = "case_id") -> DataFrame:
    """Scalable variant for very large n: each case enters replicate b with a
    Poisson(1) weight drawn by inverse CDF from u(seed, b, key); no index and
    no join.  Same estimator family, different draws from the exact version."""
    s = scores.select(key, *metrics)
    # weights: k with P(K<=k-1) <= u < P(K<=k), k = 0..12 (tail beyond is < 1e-9)
    import math
    cdf, acc = [], 0.0
    for k in range(13):
        acc += math.exp(-1) / math.factorial(k)
        cdf.append(acc)
    x = s.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))) \
         .withColumn("b", F.col("b").cast("long"))
    u = seeded_uniform(F.lit(seed), F.col("b"), F.col(key))
    wt = sum((u >= F.lit(c)).cast("int") for c in cdf)
    x = x.withColumn("w", wt)
    return x.groupBy("b").agg(*[(F.sum(F.col("w") * F.col(m)) / F.sum("w")).alias(m) for m in metrics])
