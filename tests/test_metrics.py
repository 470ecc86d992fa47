import math

import pytest
from pyspark.sql import functions as F

from bnlake.operators import metrics


def P_frame(spark, ys, probs, classes=("1", "2", "3")):
    rows = []
    for i, (y, ps) in enumerate(zip(ys, probs)):
        for j, (c, p) in enumerate(zip(classes, ps)):
            rows.append((i, y, c, j + 1, float(p)))
    return spark.createDataFrame(rows, "case_id long, y_true string, class string, class_ord int, p double")


def summary(spark, ys, probs, ks=(1, 2, 3)):
    P = P_frame(spark, ys, probs)
    sc = metrics.case_scores(P, ks=ks)
    row = metrics.topk_accuracy(sc, ks).first().asDict()
    row.update(metrics.log_loss(sc).first().asDict())
    row.update(metrics.brier(sc).first().asDict())
    row.update(metrics.ece(sc).first().asDict())
    row.update(metrics.macro_auc(P).first().asDict())
    return row


def test_identity_is_perfect(spark):
    r = summary(spark, ["1", "2", "3"], [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert r["top_1"] == 1.0 and r["ece"] == 0.0 and r["macro_auc"] == 1.0


def test_top_k(spark):
    r = summary(spark, ["2", "2"], [[.5, .4, .1], [.5, .4, .1]])
    assert r["top_1"] == 0.0 and r["top_2"] == 1.0


def test_k_clamped(spark):
    P = P_frame(spark, ["3"], [[.5, .4, .1]])
    assert metrics.topk_accuracy(metrics.case_scores(P, ks=(99,)), (99,)).first()[0] == 1.0


def test_uniform_log_loss(spark):
    r = summary(spark, ["1"], [[1 / 3, 1 / 3, 1 / 3]])
    assert r["log_loss"] == pytest.approx(math.log(3))


def test_zero_probability_is_finite(spark):
    r = summary(spark, ["3"], [[1, 0, 0]])
    assert 20 < r["log_loss"] < 30 and r["brier"] == pytest.approx(2.0)


def test_brier_value(spark):
    assert summary(spark, ["1"], [[.6, .3, .1]])["brier"] == pytest.approx(0.26)


def test_auc_one_class_is_null(spark):
    assert summary(spark, ["1", "1"], [[.6, .3, .1], [.2, .5, .3]])["macro_auc"] is None


def test_ece_confident_and_wrong(spark):
    assert summary(spark, ["2", "3"], [[1, 0, 0], [1, 0, 0]])["ece"] == pytest.approx(1.0)


def test_ece_edge_uses_literal_bins(spark):
    # 0.3 sits below the third edge (3 * 0.1 > 0.3), so it is binned with [0.2, 0.3)
    P = P_frame(spark, ["1"], [[0.3, 0.3, 0.4]])
    sc = metrics.case_scores(P).withColumn("confidence", metrics.F.lit(0.3))
    bins = {r.bin: r["count"] for r in metrics.reliability_bins(sc).collect()}
    assert bins[2] == 1 and bins[3] == 0


def test_per_class_zero_division(spark):
    P = P_frame(spark, ["1", "1"], [[.9, .1, 0], [.8, .2, 0]])
    sc = metrics.case_scores(P)
    classes = P.select("class", "class_ord").distinct()
    prf = {r["class"]: r for r in metrics.per_class_prf(sc, classes).collect()}
    assert prf["1"].precision == 1.0 and prf["2"].precision == 0.0 and prf["2"].f1 == 0.0
    assert metrics.macro_f1(metrics.per_class_prf(sc, classes)).first()[0] == 1.0


def test_bootstrap_methods_agree_roughly(spark):
    from bnlake.operators import bootstrap
    import random
    rnd = random.Random(1)
    sc = spark.createDataFrame([(i, float(rnd.random() < 0.3)) for i in range(2000)], "case_id long, hit double")
    ex = bootstrap.bootstrap_ci(sc, ["hit"], 200, 42, method="exact").first()
    po = bootstrap.bootstrap_ci(sc, ["hit"], 200, 42, method="poisson").first()
    assert ex.hit_lo < 0.3 < ex.hit_hi and po.hit_lo < 0.3 < po.hit_hi
    assert abs((ex.hit_hi - ex.hit_lo) - (po.hit_hi - po.hit_lo)) < 0.02


def test_true_class_outside_support(spark):
    """The class union adds the unseen true class with p = 0 -> loss -ln(1e-12)."""
    post = spark.createDataFrame([(1, "1", 0.7), (1, "2", 0.3)], "case_id long, class string, p double")
    truth = spark.createDataFrame([(1, "9")], "case_id long, y_true string")
    P = metrics.predict_distributions(post, truth)
    assert sorted(r["class"] for r in P.collect()) == ["1", "2", "9"]
    ll = metrics.log_loss(metrics.case_scores(P)).first()[0]
    assert ll == pytest.approx(-math.log(1e-12))


def test_auc_over_many_ranges(spark):
    """Distinct scores split over many ranges give the same AUC as counting all pairs."""
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        raw = [rnd.choice([0.1, 0.25, rnd.random()]) for _ in range(3)]
        y = rnd.choices("abc", raw)[0]
        rows += [(i, y, c, j + 1, v / sum(raw)) for j, (c, v) in enumerate(zip("abc", raw))]
    P = spark.createDataFrame(rows, "case_id long, y_true string, class string, class_ord int, p double")
    want = []
    for c in "abc":
        pos = [round(r[4], 12) for r in rows if r[2] == c and r[1] == c]
        neg = [round(r[4], 12) for r in rows if r[2] == c and r[1] != c]
        want.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = metrics.macro_auc(P).first()["macro_auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert abs(got - sum(want) / 3) < 1e-12


def test_bootstrap_draws_of_many_blocks(spark, monkeypatch):
    """Replicate sums against the stated draws in plain Python, over many blocks, sparse
    and far keys, two models, and tables of one and no row."""
    from bnlake.operators import bootstrap
    from tests.conftest import _u
    monkeypatch.setattr(bootstrap, "BLOCK", 16)
    monkeypatch.setattr(bootstrap, "BUCKET", 30)
    keys = sorted({int(_u("key", i) * 1000) for i in range(120)}) + [10 ** 15]
    value = {k: _u("value", k) for k in keys}

    def plain(keys, b):
        n, counts, total = len(keys), {}, 0.0
        for j in range(n):
            k = int(_u(7, b, j) * n) // 16
            counts[k] = counts.get(k, 0) + 1
        for k, c in counts.items():
            block = keys[16 * k:16 * k + 16]
            total += sum(value[block[int(_u(7, b, k, j) * len(block))]] for j in range(1, c + 1))
        return total / n

    for some in (keys, keys[:1]):
        df = spark.createDataFrame([(k, value[k]) for k in reversed(some)], "case_id long, hit double")
        got = {r.b: r.hit for r in bootstrap.replicate_means(df, ["hit"], 40, 7).collect()}
        assert got == {b: pytest.approx(plain(some, b)) for b in range(40)}
    both = df.selectExpr("case_id", "hit", "'a' AS model").unionByName(df.selectExpr("case_id", "hit * 2 AS hit", "'b' AS model"))
    rows = {r.model: r for r in bootstrap.bootstrap_ci_by(both, ["model"], ["hit"], 40, 7).collect()}
    assert rows["b"].hit_lo == pytest.approx(2 * rows["a"].hit_lo)
    assert bootstrap.replicate_means(df.limit(0), ["hit"], 40, 7).collect() == []


def test_no_matrix_join_sends_the_cases_through_the_driver(spark):
    from bnlake.operators import baselines
    cases = spark.createDataFrame([(i, str(i % 3)) for i in range(12)], "case_id long, y string")
    post = baselines.baseline_marginal(cases, cases, "y", "case_id")
    P = metrics.predict_distributions(post, cases.select("case_id", F.col("y").alias("y_true")))
    plan = P._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert P.count() == 36 and P.agg(F.round(F.sum("p"), 6)).first()[0] == 12.0
