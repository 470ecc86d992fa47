"""Softmax gradient boosting on histograms of categorical features.

Each round grows one tree a class, all classes together.  Rows with the same
feature values have the same scores, so the training table is first collapsed
to distinct value combinations with their class counts.  A level of all trees
is then one Spark job: every task adds up gradients, curvatures and cases by
(class, node, feature, bin) over its combinations; the partial sums, whose number
depends on the trees and bins alone, are shuffled by (class, node, feature) and
added there, and the best split of each is kept.  The driver gets one row a node
and feature and takes the best.

A split is ``feature == value`` against the rest, as on one-hot columns; null is
a value of its own.  A feature has at most ``max_bins`` values of its own, the most
frequent ones; rarer and unseen values equal none of them and go to the rest in
every split.  Trees are grown level by level, ``max_depth`` 5 giving at most 32 leaves.

A share ``held_out`` of the training rows, by a seeded hash of their key, isn't
learned from: when their log-loss hasn't improved for ``patience`` rounds boosting
stops, and the rounds up to the best one are kept (none at all if the class shares
were best).  It rides on the first job of a round.  The shares that boosting
starts from are those of all training rows.

Defined cases: rows without a target aren't learned from; one class gives
probability 1; no training rows give an empty result; ties between splits go to
the smaller feature, then the smaller bin.  Scores of finished trees are written
out every ``fold_every`` rounds, so a lost executor costs a re-read and the trees
since then, and plans stay short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import seeded_uniform, value_sort_keys
from bnlake.session import keep
from bnlake.spec import DEFAULT_SEED, LOG_CLIP

ABSENT = "__absent__"
HIST_SCHEMA = "cls int, node int, feature int, bin int, g double, h double, n double"
SPLIT_SCHEMA = "cls int, node int, feature int, bin int, gain double, g double, h double, rg double, rh double"
LOSS = -1                              # in place of a class: the held-out rows' loss


@dataclass
class Tree:
    """Arrays over nodes; node i of a split has children ``left[i]`` and ``left[i] + 1``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, left_value: float, right_value: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, at
        for v in (left_value, right_value):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
        return at, at + 1

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``codes`` (rows x features) reaches."""
        feat, bins, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        while True:
            inner = feat[at] >= 0
            if not inner.any():
                return at
            r, a = rows[inner], at[inner]
            at[inner] = left[a] + (codes[r, feat[a]] != bins[a])


@dataclass
class BoostedModel:
    features: list[str]
    bins: list[list[str]]              # values of each feature with a bin of their own
    classes: list[str]
    prior: np.ndarray                  # log of the class shares
    trees: list[list[Tree]]            # rounds x classes

    def scores(self, codes: np.ndarray, trees: list[list[Tree]] | None = None,
               start: np.ndarray | None = None) -> np.ndarray:
        s = np.tile(self.prior, (len(codes), 1)) if start is None else start.copy()
        for rnd in self.trees if trees is None else trees:
            for c, t in enumerate(rnd):
                s[:, c] += np.array(t.value)[t.nodes_of(codes)]
        return s

    def predict(self, test: DataFrame, key: str) -> DataFrame:
        """(key, class, p) for every row, one row a class."""
        if not self.classes:
            return test.select(key, F.lit("").alias("class"), F.lit(0.0).alias("p")).limit(0)
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = softmax(model.scores(matrix(b.column("codes"), len(model.features), np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(key), lists(p)], names=[key, "p"])

        kind = test.schema[key].dataType.simpleString()
        out = test.select(key, codes_column(self.features, self.bins).alias("codes")) \
                  .mapInArrow(run, f"`{key}` {kind}, p array<double>")
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.select(key, F.inline(F.arrays_zip(names.alias("class"), F.col("p").alias("p"))))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(col: pa.Array, width: int, dtype) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=dtype).reshape(len(col), width)


def lists(a: np.ndarray) -> pa.ListArray:
    off = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(a.ravel()))


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(ABSENT))


def feature_bins(train: DataFrame, features: list[str], max_bins: int) -> list[list[str]]:
    """The most frequent values of each feature, at most ``max_bins``, in value order."""
    long = train.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), filled(c).alias("value")) for i, c in enumerate(features)])))
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    top = cnt.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_bins).collect()
    return [sorted(r["value"] for r in top if r["feature"] == i) for i in range(len(features))]


def codes_column(features: list[str], bins: list[list[str]]) -> Column:
    """Bin numbers of a row; a value without a bin is -1."""
    parts = []
    for c, values in zip(features, bins):
        look = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]) if values else None
        parts.append(F.lit(-1) if look is None else F.coalesce(F.try_element_at(look, filled(c)), F.lit(-1)))
    return F.array(*[p.cast("int") for p in parts])


def partial_sums(model: BoostedModel, recent: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]]):
    """Task function: sums by (class, node, feature, bin) over the task's rows."""
    nf, nc = len(model.features), len(model.classes)
    width = max(len(v) for v in model.bins) + 1           # place 0: values without a bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = []
        for c in range(nc):
            s = np.full(len(growing[c].feature), -1)
            s[open_nodes[c]] = np.arange(len(open_nodes[c]))
            slot.append(s)
        sums = [np.zeros((3, len(open_nodes[c]) * nf * width)) for c in range(nc)]
        loss, first = 0.0, all(len(t.feature) == 1 for t in growing)
        for b in batches:
            if not b.num_rows:
                continue
            codes = matrix(b.column("codes"), nf, np.int64)
            counts = matrix(b.column("counts"), nc, np.float64)
            p = softmax(model.scores(codes, recent, matrix(b.column("scores"), nc, np.float64)))
            if first:
                held = matrix(b.column("held"), nc, np.float64)
                loss -= float((held * np.log(np.maximum(p, LOG_CLIP))).sum())
            n = counts.sum(axis=1)
            place = np.arange(nf) * width + codes + 1
            for c in range(nc):
                at = slot[c][growing[c].nodes_of(codes)]
                sel = at >= 0
                if not sel.any():
                    continue
                idx = (at[sel, None] * (nf * width) + place[sel]).ravel()
                g = n[sel] * p[sel, c] - counts[sel, c]
                h = n[sel] * p[sel, c] * (1.0 - p[sel, c])
                for k, w in enumerate((g, h, n[sel])):
                    sums[c][k] += np.bincount(idx, np.repeat(w, nf), sums[c].shape[1])
        if first:
            yield pa.RecordBatch.from_pydict(dict(cls=[LOSS], node=[0], feature=[0], bin=[0], g=[loss], h=[0.0],
                                                  n=[0.0]), schema=HIST_ARROW)
        for c in range(nc):
            i = np.flatnonzero(sums[c][2])
            node = np.array(open_nodes[c], dtype=np.int64)[i // (nf * width)] if len(i) else i
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (np.full(len(i), c), node, i // width % nf, i % width - 1)]
                + [pa.array(sums[c][k][i]) for k in range(3)], schema=HIST_ARROW)
    return run


HIST_ARROW = pa.schema([(c, pa.int32()) for c in ("cls", "node", "feature", "bin")]
                       + [(c, pa.float64()) for c in "ghn"])


def best_splits(hist: DataFrame, width: int, min_leaf: float, l2: float, min_curvature: float = 1e-3) -> DataFrame:
    """The split of highest gain of each (class, node, feature) that has one; the loss passes as ``gain``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}                # at most width sums a group
        for b in batches:
            ints = np.column_stack([b.column(i).to_numpy() for i in range(4)])
            sums = np.stack([b.column(i).to_numpy() for i in range(4, 7)])
            groups, of = np.unique(ints[:, :3], axis=0, return_inverse=True)
            of = of.ravel()
            order = np.argsort(of, kind="stable")
            for grp, at in zip(groups, np.split(order, np.flatnonzero(np.diff(of[order])) + 1)):
                t = total.setdefault(tuple(int(x) for x in grp), np.zeros((3, width)))
                np.add.at(t, (slice(None), ints[at, 3] + 1), sums[:, at])
        out = []
        for (c, node, f), t in total.items():
            if c == LOSS:
                out.append((c, node, f, 0, float(t[0].sum()), 0.0, 0.0, 0.0, 0.0))
                continue
            (g, h, n), (tg, th, tn) = t, t.sum(axis=1)
            gain = g * g / (h + l2 + 1e-15) + (tg - g) ** 2 / (th - h + l2 + 1e-15) - tg * tg / (th + l2 + 1e-15)
            ok = (np.minimum(n, tn - n) >= min_leaf) & (np.minimum(h, th - h) >= min_curvature)
            gain = np.where(ok & (np.arange(width) > 0), np.round(gain, 9), 0.0)
            k = int(gain.argmax())
            if gain[k] > 0:
                out.append((c, node, f, k - 1, float(gain[k]), float(g[k]), float(h[k]),
                            float(tg - g[k]), float(th - h[k])))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32()) for x in cols[:4]] + [pa.array(x, pa.float64()) for x in cols[4:]],
                names=["cls", "node", "feature", "bin", "gain", "g", "h", "rg", "rh"])
    return hist.repartition("cls", "node", "feature").mapInArrow(run, SPLIT_SCHEMA)


def collapse(train: DataFrame, features: list[str], target_col: str, bins: list[list[str]],
             classes: list[str], held: Column) -> DataFrame:
    """(codes, counts, held): distinct bin combinations with the learned and the held-out cases of each class."""
    rows = train.select(codes_column(features, bins).alias("codes"), F.col(target_col).cast("string").alias("y"),
                        held.alias("out"))

    def cases(out: bool) -> Column:
        return F.array(*[F.sum(((F.col("y") == F.lit(c)) & (F.col("out") == out)).cast("double")) for c in classes])

    return rows.groupBy("codes").agg(cases(False).alias("counts"), cases(True).alias("held"))


def fit(train: DataFrame, features: list[str], target_col: str, key: str, rounds: int = 100, rate: float = 0.1,
        max_depth: int = 5, min_leaf: int = 20, l2: float = 0.0, max_bins: int = 255, fold_every: int = 10,
        held_out: float = 0.1, patience: int = 10, seed: int = DEFAULT_SEED) -> BoostedModel:
    train = train.filter(F.col(target_col).isNotNull())
    held = F.coalesce(seeded_uniform(F.lit(seed), F.lit("held"), F.col(key)) < held_out, F.lit(False))
    freq = train.groupBy(F.col(target_col).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(*value_sort_keys(F.col("class"))).collect()
    classes, n = [r["class"] for r in freq], np.array([r["n"] for r in freq], dtype=float)
    bins = feature_bins(train, features, max_bins)
    model = BoostedModel(features, bins, classes, np.log(n / n.sum()), [])
    if len(classes) < 2 or not features:
        return model
    rows = keep(collapse(train, features, target_col, bins, classes, held).withColumn(
        "scores", F.array(*[F.lit(float(x)) for x in model.prior])))
    width = max(len(v) for v in bins) + 1
    folded, losses = 0, []
    while len(model.trees) <= rounds:
        growing, open_nodes = [Tree() for _ in classes], [[0] for _ in classes]
        for level in range(max_depth):
            run = partial_sums(model, model.trees[folded:], growing, open_nodes)
            found = best_splits(rows.mapInArrow(run, HIST_SCHEMA), width, float(min_leaf), l2).collect()
            if level == 0:
                losses += [r["gain"] for r in found if r["cls"] == LOSS]
            best: dict[tuple, tuple] = {}
            for r in found:
                at, rank = (r["cls"], r["node"]), (r["gain"], -r["feature"])
                if r["cls"] != LOSS and (at not in best or rank > best[at][0]):
                    best[at] = (rank, r)
            if level == 0 and _stopped(losses, len(model.trees), rounds, held_out, patience):
                break
            open_nodes = [[] for _ in classes]
            for (c, node), (_, r) in sorted(best.items()):
                open_nodes[c] += growing[c].split(node, r["feature"], r["bin"],
                                                  -rate * r["g"] / (r["h"] + l2 + 1e-15),
                                                  -rate * r["rg"] / (r["rh"] + l2 + 1e-15))
            if not any(open_nodes):
                break
        if all(len(t.feature) == 1 for t in growing):
            break                                    # stopped, or no split of any class gains anything
        model.trees.append(growing)
        if len(model.trees) - folded >= fold_every:
            rows, folded = keep(_fold(rows, model, model.trees[folded:])), len(model.trees)
    if held_out > 0 and losses:
        model.trees = model.trees[:int(np.argmin(losses))]
    return model


def _stopped(losses: list[float], grown: int, rounds: int, held_out: float, patience: int) -> bool:
    """All rounds are grown, or the held-out loss (one entry a round, before it) was best ``patience`` rounds ago."""
    return grown >= rounds or (held_out > 0 and len(losses) - 1 - int(np.argmin(losses)) >= patience)


def _fold(rows: DataFrame, model: BoostedModel, recent: list[list[Tree]]) -> DataFrame:
    """Adds the finished trees to the stored scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = matrix(b.column("codes"), len(model.features), np.int64)
            s = model.scores(codes, recent, matrix(b.column("scores"), len(model.classes), np.float64))
            yield pa.RecordBatch.from_arrays([b.column("codes"), b.column("counts"), b.column("held"), lists(s)],
                                             names=["codes", "counts", "held", "scores"])
    return rows.mapInArrow(run, rows.schema)
