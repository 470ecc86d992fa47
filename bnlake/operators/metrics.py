"""Scoring on the long posterior table (M0-M7, M9-M11, M13, A12, SET2).

Input everywhere: ``P`` = (key, y_true, class, class_ord, p), one row per case
and class, rows normalised.  Every metric is an aggregate of per-case columns,
so the whole evaluation is a handful of shuffles keyed by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import clip_log, value_sort_keys


# ---------------------------------------------------------------------------
# SET2 + M0
# ---------------------------------------------------------------------------
def class_union(truth: DataFrame, post: DataFrame) -> DataFrame:
    """SET2: classes = observed truths UNION predicted support, in domain order."""
    u = truth.select(F.col("y_true").alias("class")).union(post.select("class")) \
             .filter(F.col("class").isNotNull()).distinct()
    w = Window.orderBy(*value_sort_keys(F.col("class")))   # bounded: one row per class
    return u.withColumn("class_ord", F.row_number().over(w).cast("int"))


def collect_classes(classes: DataFrame) -> list[str]:
    """The class list: one row per class of the target."""
    return [r["class"] for r in classes.orderBy("class_ord").collect()]


def predict_distributions(post: DataFrame, truth: DataFrame, key: str = "case_id",
                          classes: list[str] | None = None) -> DataFrame:
    """M0: long matrix P over the class list, zero-filled and row-normalised.

    post: (key, class, p) from any engine; truth: (key, y_true) -- rows with a
    null truth are skipped.  Each case is expanded over the (small, collected)
    class list with a literal array, then the engine's mass is left-joined.
    Both joins are merges: each side has a row for every case, and Spark takes the
    size of a generated table for that of the few columns that it was generated
    from, so it would send all cases through the driver.
    """
    truth = truth.filter(F.col("y_true").isNotNull())
    if classes is None:
        classes = collect_classes(class_union(truth, post))
    arr = F.array(*[F.lit(c) for c in classes])
    have = post.select(key).distinct().hint("merge")
    base = truth.join(have, key).select(key, "y_true", F.posexplode(arr).alias("_o", "class"))
    mass = post.select(key, "class", F.col("p").alias("_p")).hint("merge")
    j = base.join(mass, [key, "class"], "left")
    w = Window.partitionBy(key)
    raw = F.coalesce(F.col("_p"), F.lit(0.0))
    tot = F.sum(raw).over(w)
    return j.select(key, "y_true", "class", (F.col("_o") + 1).cast("int").alias("class_ord"),
                    F.when(tot > 0, raw / tot).otherwise(F.lit(1.0 / len(classes))).alias("p"))


# ---------------------------------------------------------------------------
# Per-case score columns
# ---------------------------------------------------------------------------
def case_scores(P: DataFrame, key: str = "case_id", ks=(1, 3, 5)) -> DataFrame:
    """One row per case: true-class rank, p_true, brier term, top-1 prediction
    and confidence.  The per-case window holds C rows (the class count)."""
    w = Window.partitionBy(key).orderBy(F.col("p").desc(), F.col("class_ord").asc())
    r = P.withColumn("_rank", F.row_number().over(w))
    is_true = F.col("class") == F.col("y_true")
    agg = r.groupBy(key, "y_true").agg(
        F.min(F.when(is_true, F.col("_rank"))).alias("true_rank"),
        F.sum(F.when(is_true, F.col("p")).otherwise(0.0)).alias("p_true"),
        F.sum((F.col("p") - is_true.cast("double")) ** 2).alias("brier"),
        F.max(F.when(F.col("_rank") == 1, F.col("class"))).alias("pred"),
        F.max("p").alias("confidence"),
        F.count(F.lit(1)).alias("n_classes"))
    out = agg.withColumn("log_loss", -clip_log(F.col("p_true")))
    for k in ks:
        kk = F.least(F.lit(k), F.col("n_classes"))
        out = out.withColumn(f"hit_{k}", (F.coalesce(F.col("true_rank"), F.lit(1 << 30)) <= kk)
                             .cast("double"))
    return out.withColumn("correct", (F.col("pred") == F.col("y_true")).cast("double"))


# ---------------------------------------------------------------------------
# M1-M7
# ---------------------------------------------------------------------------
def topk_accuracy(scores: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """M1: one row, ``top_k`` per k (0 on an empty set)."""
    return scores.agg(*[F.coalesce(F.avg(f"hit_{k}"), F.lit(0.0)).alias(f"top_{k}") for k in ks])


def log_loss(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("log_loss").alias("log_loss"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("brier").alias("brier"))


def macro_auc(P: DataFrame) -> DataFrame:
    """M4: macro one-vs-rest AUC over classes present in the truth (<2 -> null).

    Scores are grouped to (class, p) with positive and negative counts, then
    split into ranges of (class, p) and written with the number of their range.
    The negatives below a score are those of the class's earlier ranges (one
    row a class and range) and those below it in its own range, so no window is
    larger than a range, however many distinct scores a class has."""
    from bnlake.session import keep
    # scores equal to 12 places are one tie (engines differ in the last bits)
    g = P.withColumn("p", F.round("p", 12)).groupBy("class", "p").agg(
        F.sum((F.col("class") == F.col("y_true")).cast("long")).alias("pos"),
        F.sum((F.col("class") != F.col("y_true")).cast("long")).alias("neg"))
    g = keep(g.repartitionByRange("class", "p").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = g.groupBy("class", "part").agg(F.sum("neg").alias("_n")).select(
        "class", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("class", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_in", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(offsets, ["class", "part"]) \
         .withColumn("neg_below", F.col("_off") + F.col("_in"))
    per = g.groupBy("class").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    per = per.filter((F.col("P") > 0) & (F.col("N") > 0)) \
             .withColumn("auc", F.col("u") / (F.col("P") * F.col("N")))
    present = P.filter(F.col("class") == F.col("y_true")).select("class").distinct() \
               .withColumn("_present", F.lit(1))
    per = per.join(present, "class", "right")      # classes present in the truth (few rows)
    return per.agg(F.when((F.count(F.lit(1)) >= 2) & (F.count("auc") > 0),
                          F.avg("auc")).alias("macro_auc"))


# ECE bin edges as an evenly spaced grid of 11 points on [0, 1] computes them
# (i * 0.1, last edge exactly 1.0).
def ece_edges(n_bins: int = 10) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def ece_bin(conf: Column, n_bins: int = 10) -> Column:
    edges = ece_edges(n_bins)
    return sum((conf >= F.lit(edges[i])).cast("int") for i in range(1, n_bins))


def reliability_bins(scores: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, lo, hi, count, accuracy, confidence, gap); empty bins get
    accuracy 0 and the bin midpoint as confidence.  The bin table is
    generated with spark.range so every bin appears."""
    edges = ece_edges(n_bins)
    b = scores.withColumn("bin", ece_bin(F.col("confidence"), n_bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("correct").alias("acc"),
        F.avg("confidence").alias("conf"))
    lo = F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges[1:]]), F.col("bin") + 1)
    bins = scores.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    j = bins.join(b, "bin", "left")
    return j.select(
        "bin", lo.alias("lo"), hi.alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("acc", F.lit(0.0)).alias("accuracy"),
        F.coalesce("conf", (lo + hi) / 2).alias("confidence"),
    ).withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def ece(scores: DataFrame, n_bins: int = 10) -> DataFrame:
    """M5: count-weighted mean |accuracy - confidence| over bins."""
    b = scores.withColumn("bin", ece_bin(F.col("confidence"), n_bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("c"), F.avg("correct").alias("a"), F.avg("confidence").alias("f"))
    return b.agg((F.sum(F.col("c") * F.abs(F.col("a") - F.col("f"))) / F.sum("c")).alias("ece"))


def per_class_prf(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """M6: precision / recall / F1 / support per class from top-1 predictions
    (zero division -> 0)."""
    t = scores.groupBy(F.col("y_true").alias("class")).agg(
        F.count(F.lit(1)).alias("support"), F.sum("correct").alias("tp"))
    pcount = scores.groupBy(F.col("pred").alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = classes.select("class", "class_ord").join(t, "class", "left").join(pcount, "class", "left")
    tp = F.coalesce("tp", F.lit(0.0))
    sup = F.coalesce("support", F.lit(0)).cast("long")
    npred = F.coalesce("n_pred", F.lit(0))
    prec = F.when(npred > 0, tp / npred).otherwise(0.0)
    rec = F.when(sup > 0, tp / sup).otherwise(0.0)
    out = j.select("class", "class_ord", prec.alias("precision"), rec.alias("recall"),
                   sup.alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return out.withColumn("f1", f1)


def macro_f1(prf: DataFrame, rounded: bool = False) -> DataFrame:
    """M7: mean F1 over classes with support > 0 (unrounded unless asked, T11)."""
    f = F.round("f1", 3) if rounded else F.col("f1")
    return prf.filter(F.col("support") > 0).agg(
        F.coalesce(F.avg(f), F.lit(0.0)).alias("macro_f1"))


def confusion_matrix(scores: DataFrame) -> DataFrame:
    """A12 (long form): true x predicted counts."""
    return scores.groupBy("y_true", "pred").agg(F.count(F.lit(1)).alias("count"))


def confusion_wide(scores: DataFrame, classes: list[str]) -> DataFrame:
    """A12 (wide form): pivot on the known class list, zero-filled."""
    return scores.groupBy("y_true").pivot("pred", classes).count().fillna(0)


# ---------------------------------------------------------------------------
# M9 (point estimates; intervals come from bootstrap.py)
# ---------------------------------------------------------------------------
def summary_row(P: DataFrame, key: str = "case_id", ks=(1, 3, 5)) -> DataFrame:
    """All point metrics in one row: n_test, n_classes, top_k, log_loss, brier,
    macro_auc, ece, macro_f1.  k larger than the class count gives null."""
    from bnlake.session import keep
    sc = keep(case_scores(P, key, ks))     # every metric below reads this once-computed table
    ncls = P.agg(F.count_distinct("class").alias("n_classes"))
    base = sc.agg(F.count(F.lit(1)).alias("n_test"),
                  *[F.avg(f"hit_{k}").alias(f"top_{k}") for k in ks],
                  F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))
    classes = P.select("class", "class_ord").distinct()
    parts = [base, ncls, macro_auc(P), ece(sc), macro_f1(per_class_prf(sc, classes))]
    # one-row frames combined without a join: stack as (metric, value), pivot back
    names = [c for p in parts for c in p.columns]
    longs = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in p.columns]))) for p in parts]
    stacked = longs[0]
    for x in longs[1:]:
        stacked = stacked.unionByName(x)
    out = stacked.groupBy().pivot("metric", names).agg(F.first("value"))
    out = out.withColumn("n_test", F.col("n_test").cast("long")) \
             .withColumn("n_classes", F.col("n_classes").cast("long"))
    for k in ks:
        out = out.withColumn(f"top_{k}", F.when(F.lit(k) <= F.col("n_classes"), F.col(f"top_{k}")))
    return out
