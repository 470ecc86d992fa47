"""Softmax boosting against a plain brute-force version."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from bnlake.operators import boosting
from bnlake.operators.baselines import baseline_gbt


def _rows(n=240):
    out = []
    for i in range(n):
        a, b, c = "xyz"[i * 7 % 3], None if i % 5 == 0 else str(i % 4), str(i * i % 7)
        y = "2" if (a == "x") != (b == "1") else ("10" if i % 3 else "3")
        if i % 11 == 0:
            y = "3"
        out.append((i, a, b, c, y))
    return out


def _brute(train, test, rounds, rate, depth, min_leaf):
    """Every split of every node tried by re-adding the rows of both sides."""
    feats = lambda r: tuple("__absent__" if v is None else v for v in r[1:4])
    X, Y = [feats(r) for r in train], [r[4] for r in train]
    classes = sorted(set(Y), key=float)
    prior = [math.log(Y.count(c) / len(Y)) for c in classes]
    S, T = [prior[:] for _ in X], [prior[:] for _ in test]
    values = [sorted({x[f] for x in X}) for f in range(3)]

    def soft(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    def grow(rows, tests, c, P, d):
        g = {i: P[i][c] - (Y[i] == classes[c]) for i in rows}
        h = {i: P[i][c] * (1 - P[i][c]) for i in rows}
        part = lambda side: sum(g[i] for i in side) ** 2 / (sum(h[i] for i in side) + 1e-15)
        best = None
        for f, v in itertools.chain.from_iterable([(f, v) for v in values[f]] for f in range(3)) if d < depth else ():
            left = [i for i in rows if X[i][f] == v]
            right = [i for i in rows if X[i][f] != v]
            if min(len(left), len(right)) < min_leaf or min(sum(h[i] for i in left), sum(h[i] for i in right)) < 1e-3:
                continue
            gain = round(part(left) + part(right) - part(rows), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, v, left, right)
        if best is None:
            if d == 0:
                return
            val = -rate * sum(g.values()) / (sum(h.values()) + 1e-15)
            for i in rows:
                S[i][c] += val
            for t in tests:
                T[t][c] += val
            return
        _, f, v, left, right = best
        grow(left, [t for t in tests if feats(test[t])[f] == v], c, P, d + 1)
        grow(right, [t for t in tests if feats(test[t])[f] != v], c, P, d + 1)

    for _ in range(rounds):
        P = [soft(s) for s in S]
        for c in range(len(classes)):
            grow(list(range(len(X))), list(range(len(test))), c, P, 0)
    return {(test[t][0], c): p for t in range(len(test)) for c, p in zip(classes, soft(T[t]))}


SCHEMA = "id long, a string, b string, c string, y string"


def test_boosting_equals_brute_force(spark):
    rows = _rows()
    test = rows[:30] + [(1000, "new", None, "5", None), (1001, None, "9", None, None)]
    tr = spark.createDataFrame(rows + [(9999, "x", "1", "1", None)], SCHEMA).repartition(5)
    te = spark.createDataFrame(test, SCHEMA)
    got = baseline_gbt(tr, te, ["a", "b", "c"], "y", "id", rounds=4, max_depth=3, min_leaf=8, fold_every=3,
                       held_out=0.0)
    got = {(r["id"], r["class"]): r["p"] for r in got.collect()}
    want = _brute(rows, test, 4, 0.1, 3, 8)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_boosting_odd_tables(spark):
    te = spark.createDataFrame([(1, "x", None, None, None)], SCHEMA)
    empty = te.limit(0)
    assert baseline_gbt(empty, te, ["a", "b"], "y", "id").count() == 0
    one = spark.createDataFrame([(1, "x", None, "1", "7")] * 3, SCHEMA)
    assert [(r["class"], r["p"]) for r in baseline_gbt(one, te, ["a", "b"], "y", "id").collect()] == [("7", 1.0)]
    tr = spark.createDataFrame(_rows(60), SCHEMA)
    assert baseline_gbt(tr, empty, ["a", "b"], "y", "id", rounds=1).count() == 0


def test_values_beyond_max_bins_have_no_bin(spark):
    tr = spark.createDataFrame([(i, v, None, None, "1") for i, v in enumerate("aaabbcd")], SCHEMA)
    assert boosting.feature_bins(tr, ["a", "b"], 2) == [["a", "b"], ["__absent__"]]
    codes = tr.select(boosting.codes_column(["a"], [["a", "b"]]).alias("k")).select(F.col("k")[0].alias("k"))
    assert sorted(r["k"] for r in codes.collect()) == [-1, -1, 0, 0, 0, 1, 1]


def test_held_out_rows_stop_the_boosting(spark):
    """Classes that don't depend on the features: few rounds or none are kept, all within the patience."""
    noise = [(i, "xyz"[i % 3], str(i % 4), str(i % 7), "23"[i * 2654435761 % 2 ** 32 >> 31]) for i in range(400)]
    m = boosting.fit(spark.createDataFrame(noise, SCHEMA), ["a", "b", "c"], "y", "id", rounds=30, max_depth=2,
                     min_leaf=5, patience=2)
    assert len(m.trees) < 15
    assert not boosting._stopped([3.0, 2.0, 2.5], 2, 30, 0.1, 2)
    assert boosting._stopped([3.0, 2.0, 2.5, 2.1], 3, 30, 0.1, 2)
    assert boosting._stopped([3.0], 30, 30, 0.0, 2)


@pytest.mark.parametrize("depth", [1, 2])
def test_leaf_count_follows_depth(spark, depth):
    m = boosting.fit(spark.createDataFrame(_rows(), SCHEMA), ["a", "b", "c"], "y", "id", rounds=1, held_out=0.0, max_depth=depth, min_leaf=5)
    assert all(t.feature.count(-1) <= 2 ** depth for t in m.trees[0])


def test_boosting_beats_the_class_shares(spark):
    """Classes that depend on the features, early stopping on: unseen rows are scored better than by the marginal."""
    rows = _rows(600)
    m = boosting.fit(spark.createDataFrame(rows[:400], SCHEMA), ["a", "b", "c"], "y", "id", rounds=25, max_depth=2,
                     min_leaf=5)
    got = {(r["id"], r["class"]): r["p"] for r in m.predict(spark.createDataFrame(rows[400:], SCHEMA), "id").collect()}
    share = {c: sum(r[4] == c for r in rows[:400]) / 400 for c in ("2", "3", "10")}
    loss = sum(-math.log(got[r[0], r[4]]) for r in rows[400:]) / 200
    assert len(m.trees) > 5 and loss < 0.8 * sum(-math.log(share[r[4]]) for r in rows[400:]) / 200
