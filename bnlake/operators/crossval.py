"""k-fold cross-validation (M12) from one counting pass.

The data are read once: CPT counts are aggregated with the fold id in every
grouping set.  Fold f's training counts are total minus fold f's counts, its
domains the values whose remaining count is positive; each fold's CPT, factors
and posteriors are then built from those small tables.  Mean and population
standard deviation of the per-fold top-k accuracy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import value_sort_keys
from bnlake.operators import cpt as cptops
from bnlake.operators import metrics, posterior, prep
from bnlake.operators.split import kfold_assign
from bnlake.session import keep
from bnlake.spec import DEFAULT_ALPHA, DEFAULT_M, DEFAULT_SEED, NetworkSpec


def fold_counts(counts_by_fold: DataFrame, fold: int, M: int) -> DataFrame:
    """Training counts of one fold = totals - that fold's counts (zeros dropped)."""
    keys = ["node", "depth"] + [f"pa{i}" for i in range(1, M + 1)] + ["value"]
    tot = counts_by_fold.groupBy(*keys).agg(F.sum("n").alias("N"))
    mine = counts_by_fold.filter(F.col("fold") == fold).select(*keys, F.col("n").alias("nf"))
    j = tot.join(mine, [tot[k].eqNullSafe(mine[k]) for k in keys], "left")
    return j.select(*[tot[k] for k in keys],
                    (F.col("N") - F.coalesce(F.col("nf"), F.lit(0))).cast("long").alias("n")) \
            .filter(F.col("n") > 0)


def cross_validate(spark: SparkSession, cases: DataFrame, spec: NetworkSpec, k: int = 5,
                   topk: int = 3, track: str | None = "explanatory", seed: int = DEFAULT_SEED,
                   alpha: float = DEFAULT_ALPHA, m: float = DEFAULT_M,
                   backoff: bool = True) -> DataFrame:
    """(fold, n_test, accuracy, mean, std) -- one row per fold."""
    spec = spec.restrict(cases.columns)
    key = spec.key
    folded = keep(kfold_assign(cases, k, key, seed))
    nodes = folded.select("fold", *prep.node_columns(folded, spec)).dropna(subset=spec.names)
    by_fold = keep(cptops.cpt_counts(nodes, spec, by=["fold"]))     # the only pass over the data
    ev_vars = spec.track(track)
    rows = []
    for f in range(k):
        cf = keep(fold_counts(by_fold, f, spec.max_parents))
        dom = cf.filter(F.col("depth") == 0).select("node", "value").distinct()
        dom = keep(dom.withColumn("ord", F.row_number().over(
            Window.partitionBy("node").orderBy(*value_sort_keys(F.col("value")))).cast("int")))
        cpt = cptops.fit_network(nodes.drop("fold"), spec, alpha, m, backoff, counts=cf, domains=dom)
        doms = cptops.collect_domains(dom)
        card = cptops.domain_card(dom)
        facs = posterior.network_factors(cptops.factor_long(spark, cpt, card, spec, doms, alpha), spec, doms)
        test = folded.filter(F.col("fold") == f)
        ev = prep.evidence_project(test, spec, track)
        post = posterior.posterior_exact(spark, spec, facs, doms, ev, ev_vars)
        truth = ev.select(key, "y_true")
        P = metrics.predict_distributions(post, truth, key)
        sc = metrics.case_scores(P, key, (topk,))
        rows.append(sc.agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n_test"),
                           F.coalesce(F.avg(f"hit_{topk}"), F.lit(0.0)).alias("accuracy")))
    out = keep(reduce(DataFrame.unionByName, rows))
    w = Window.partitionBy()          # k rows
    return out.withColumn("mean", F.avg("accuracy").over(w)) \
              .withColumn("std", F.stddev_pop("accuracy").over(w))
