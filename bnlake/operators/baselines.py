"""Reference models (B1-B6).  A model is ``f(train, test) -> long posterior``
(key, class, p), so every baseline drops into the same metrics.

Marginal and majority are aggregates; logistic regression uses Spark ML on one-hot
features where a missing value is its own "absent" category; boosting is in
``boosting.py``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import value_sort_keys

log = logging.getLogger(__name__)
ABSENT = "__absent__"


def class_frequencies(train: DataFrame, target_col: str) -> DataFrame:
    """(class, class_ord, count, p): unsmoothed training frequencies."""
    c = train.filter(F.col(target_col).isNotNull()).groupBy(
        F.col(target_col).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()   # one row per class
    c = c.withColumn("p", F.col("count") / F.sum("count").over(w))
    return c.withColumn("class_ord", F.row_number().over(
        Window.orderBy(*value_sort_keys(F.col("class")))).cast("int"))


def _spread(test: DataFrame, key: str, dist: list[tuple[str, float]]) -> DataFrame:
    """Every test case gets the same (class, p) list -- a literal array per row."""
    arr = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(p).alias("p")) for c, p in dist])
    return test.select(key, F.inline(arr))


def _class_rows(train: DataFrame, target_col: str) -> list:
    """Class frequencies on the driver: one row per class of the target."""
    return class_frequencies(train, target_col).orderBy("class_ord").collect()


def baseline_marginal(train: DataFrame, test: DataFrame, target_col: str, key: str) -> DataFrame:
    """B1: the class distribution of the training set, for every case."""
    rows = _class_rows(train, target_col)
    return _spread(test, key, [(r["class"], float(r["p"])) for r in rows])


def baseline_majority(train: DataFrame, test: DataFrame, target_col: str, key: str) -> DataFrame:
    """B2: 0.99 on the modal class (ties -> first in class order), 0.01/(C-1) elsewhere."""
    rows = _class_rows(train, target_col)
    if not rows:
        return _spread(test, key, [])
    mode = max(rows, key=lambda r: (r["count"], -r["class_ord"]))["class"]
    floor = 0.01 / max(1, len(rows) - 1)
    return _spread(test, key, [(r["class"], 0.99 if r["class"] == mode else floor) for r in rows])


def onehot_features(train: DataFrame, test: DataFrame, feature_cols: list[str],
                    target_col: str):
    """Null -> "__absent__" category; StringIndexer(keep) + OneHotEncoder(dropLast):
    a category unseen in training lands in the keep slot, which encodes as zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    def fill(df):
        return df.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit(ABSENT)).alias(f"_s_{c}")
                                for c in feature_cols])

    tr, te = fill(train.filter(F.col(target_col).isNotNull())), fill(test)
    stages = [StringIndexer(inputCols=[f"_s_{c}" for c in feature_cols],
                            outputCols=[f"_i_{c}" for c in feature_cols], handleInvalid="keep",
                            stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=[f"_i_{c}" for c in feature_cols],
                            outputCols=[f"_o_{c}" for c in feature_cols], dropLast=True,
                            handleInvalid="keep"),
              VectorAssembler(inputCols=[f"_o_{c}" for c in feature_cols], outputCol="features"),
              StringIndexer(inputCol=target_col, outputCol="label", stringOrderType="alphabetAsc")]
    tr = tr.withColumn(target_col, F.col(target_col).cast("string"))
    model = Pipeline(stages=stages[:3]).fit(tr)
    lab = stages[3].fit(tr)
    return model.transform(lab.transform(tr)), model.transform(te), lab.labels


def _proba_long(pred: DataFrame, key: str, labels: list[str], col: str = "probability") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(col))
    return pred.select(key, F.posexplode(arr).alias("_i", "p")).select(
        key, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_i") + 1).alias("class"), "p")


def baseline_logreg(train: DataFrame, test: DataFrame, feature_cols: list[str], target_col: str,
                    key: str, max_iter: int = 1000) -> DataFrame:
    """Multinomial logistic regression with an L2 penalty of weight 1/n
    (the C=1 objective of the usual formulation, divided by n)."""
    from pyspark.ml.classification import LogisticRegression
    tr, te, labels = onehot_features(train, test, feature_cols, target_col)
    n = tr.count()
    lr = LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, maxIter=max_iter)
    return _proba_long(lr.fit(tr).transform(te), key, labels)


def baseline_gbt(train: DataFrame, test: DataFrame, feature_cols: list[str], target_col: str,
                 key: str, rounds: int = 100, **params) -> DataFrame:
    """Multi-class softmax boosting by histograms (``boosting.fit`` has the parameters)."""
    from bnlake.operators import boosting
    return boosting.fit(train, feature_cols, target_col, key, rounds=rounds, **params).predict(test, key)


def baseline_set(train: DataFrame, test: DataFrame, feature_cols: list[str], target_col: str,
                 key: str, include_ml: bool = True, seed: int = 42) -> DataFrame:
    """Tagged union of the baselines; ML failures are logged and skipped."""
    parts = [baseline_marginal(train, test, target_col, key).withColumn("model", F.lit("marginal")),
             baseline_majority(train, test, target_col, key).withColumn("model", F.lit("majority"))]
    if include_ml:
        for name, fn in (("logistic", baseline_logreg), ("boosting", baseline_gbt)):
            try:
                parts.append(fn(train, test, feature_cols, target_col, key).withColumn("model", F.lit(name)))
            except Exception as exc:  # noqa: BLE001
                log.warning("baseline %s skipped: %s", name, exc)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
