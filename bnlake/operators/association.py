"""Pairwise association (A13, D1-D6, W5) for every variable pair in one job.

All pair contingencies come from one aggregate keyed by (pair id, values), for any
number of variables.  Pairwise deletion drops a row from the pairs of its null
columns.  Marginals are windows over one pair's cells, so no join is needed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import chi2_sf, chi2_sf_even
from bnlake.operators.cpt import weighted
from bnlake.operators.setcount import count_sets


def contingency(df: DataFrame, variables: list[str]) -> DataFrame:
    """(var_a, var_b, a, b, n) for every pair (a before b in variable
    order), rows with a null in either column excluded for that pair. Any number
    of variables."""
    pairs = [list(p) for p in combinations(variables, 2)]
    cells = count_sets(weighted(df.select(*[F.col(f"`{v}`") for v in variables]), variables), variables, pairs, "_w")
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                            "set_id int, var_a string, var_b string")
    return cells.join(F.broadcast(names), "set_id") \
                .select("var_a", "var_b", F.get("vals", F.lit(0)).alias("a"), F.get("vals", F.lit(1)).alias("b"), "n")


def pair_stats(cont: DataFrame) -> DataFrame:
    """Per pair: n, deviation D, mutual information (nats), entropies, G, dof."""
    pw = Window.partitionBy("var_a", "var_b")
    c = cont.withColumn("n_tot", F.sum("n").over(pw)) \
            .withColumn("na", F.sum("n").over(Window.partitionBy("var_a", "var_b", "a"))) \
            .withColumn("nb", F.sum("n").over(Window.partitionBy("var_a", "var_b", "b")))
    pab = F.col("n") / F.col("n_tot")
    pa = F.col("na") / F.col("n_tot")
    pb = F.col("nb") / F.col("n_tot")
    c = c.withColumn("dev", F.abs(pab - pa * pb)) \
         .withColumn("mi_t", pab * F.log(pab / (pa * pb)))
    # entropies from the marginals: each marginal cell counted once per value
    first_a = F.row_number().over(Window.partitionBy("var_a", "var_b", "a").orderBy("b")) == 1
    first_b = F.row_number().over(Window.partitionBy("var_a", "var_b", "b").orderBy("a")) == 1
    c = c.withColumn("ha_t", F.when(first_a, -pa * F.log(pa)).otherwise(0.0)) \
         .withColumn("hb_t", F.when(first_b, -pb * F.log(pb)).otherwise(0.0)) \
         .withColumn("fa", first_a.cast("int")).withColumn("fb", first_b.cast("int"))
    s = c.groupBy("var_a", "var_b").agg(
        F.first("n_tot").alias("n_pairs"), F.avg("dev").alias("deviation"),
        F.sum("mi_t").alias("mi_raw"), F.sum("ha_t").alias("h_a"), F.sum("hb_t").alias("h_b"),
        F.sum("fa").alias("card_a"), F.sum("fb").alias("card_b"))
    mi = F.greatest(F.col("mi_raw"), F.lit(0.0))
    nmi = F.when((F.col("h_a") > 0) & (F.col("h_b") > 0),
                 F.least(F.lit(1.0), mi / F.sqrt(F.col("h_a") * F.col("h_b")))).otherwise(0.0)
    return s.select("var_a", "var_b", F.col("n_pairs").cast("long").alias("n"), "deviation",
                    mi.alias("mutual_info"), nmi.alias("nmi"),
                    (2.0 * F.col("n_pairs") * mi).alias("g"),
                    ((F.col("card_a") - 1) * (F.col("card_b") - 1)).cast("int").alias("dof"))


def g_test(stats: DataFrame, exact_odd: bool = False) -> DataFrame:
    """G = 2 N I(A;B), dof = (|A|-1)(|B|-1), p = chi-square survival.
    Even dof: closed-form finite sum on the JVM; odd dof: null unless
    ``exact_odd`` (then the incomplete gamma function for every dof)."""
    p = chi2_sf(F.col("g"), F.col("dof")) if exact_odd else chi2_sf_even(F.col("g"), F.col("dof"))
    return stats.select("var_a", "var_b", "n", "g", "dof", p.alias("p_value"))


def dependency_matrix(stats: DataFrame, variables: list[str], method: str = "deviation") -> DataFrame:
    """D5 (long form): symmetric, zero diagonal."""
    col = {"deviation": "deviation", "mutual_info": "mutual_info", "nmi": "nmi"}[method]
    s = stats.select("var_a", "var_b", F.col(col).alias("score"))
    flipped = s.select(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "score")
    diag = stats.sparkSession.createDataFrame([(v, v, 0.0) for v in variables],
                                              "var_a string, var_b string, score double")
    return s.unionByName(flipped).unionByName(diag)


def top_dependencies(stats: DataFrame, variables: list[str], method: str = "deviation",
                     threshold: float = 0.01, top_n: int = 20) -> DataFrame:
    """Score (6 dp) >= threshold, strongest first, first ``top_n`` -- a top-k report."""
    col = {"deviation": "deviation", "mutual_info": "mutual_info"}[method]
    pos = F.create_map(*[x for i, v in enumerate(variables) for x in (F.lit(v), F.lit(i))])
    s = stats.filter(F.col(col) >= threshold).select(
        "var_a", "var_b", F.round(F.col(col), 6).alias("score"),
        pos[F.col("var_a")].alias("_ia"), pos[F.col("var_b")].alias("_ib"))
    w = Window.orderBy(F.col("score").desc(), "_ia", "_ib")   # pairs: at most m(m-1)/2 rows
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n) \
            .drop("_ia", "_ib")


def dependency_report(stats: DataFrame, variables: list[str], threshold: float = 0.001,
                      top_n: int = 20) -> DataFrame:
    """Top pairs by deviation and by mutual information, tagged."""
    a = top_dependencies(stats, variables, "deviation", threshold, top_n) \
        .withColumn("method", F.lit("deviation"))
    b = top_dependencies(stats, variables, "mutual_info", threshold, top_n) \
        .withColumn("method", F.lit("mutual_info"))
    return a.unionByName(b)
