"""SimHash near-duplicates, candidates by pigeonring filtering.

Fingerprint: 64 bits over the XXH64 values (seed 42) of a text's word shingles;
a bit is 1 if it is set in over half of them. Two fingerprints link when at most
``max_bits`` bits differ; classes are the connected components of the links.

Pigeonring: with ``max_bits`` = t the fingerprint is a ring of m = t + 1 segments.
If at most t bits differ, some start i has, for every length l, at most l*t/m
differences in the l consecutive segments from i on. So segment i is equal and
segment i + 1 differs in at most one bit, hence one of its halves is equal too.
Each distinct fingerprint is filed under 2m keys (start, segment, half of the
next); inside a key the longer chains prune the pairs, and the chain of all m
segments is the full Hamming check.

No pair list is built: distinct fingerprints stand for their copies, and inside
a key only a spanning forest of the links is emitted. A key with more than
``key_limit`` fingerprints goes the other exact way: fingerprints within t bits
meet in a value at most ceil(t/2) bits from both, and all that meet in one value
are linked as a star if they are within t bits of its smallest (t even: always).

Null text, empty text and text without a word: fingerprint zero. Fewer words
than the shingle length: one shingle of all of them. Repeated rows fall into one
class. A null doc_id is kept, and is never a component_id unless a class has no
other id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bnlake.llm.common import byte_texts, staged

BITS = 64
#: Shingles whose bits are counted at once (memory of a very long text).
BLOCK = 1 << 16


def simhash(text: bytes | None, shingle: int) -> int:
    w = text.lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    h = np.array([xxh64_intdigest(joined[a:b], 42)
                  for a, b in zip(begins[:len(w) - k + 1].tolist(), ends[k - 1:].tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in byte_texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def ring(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the m segments."""
    m, at, out = max_bits + 1, 0, []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        out.append((at, width))
        at += width
    return out


def _mask(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks(max_bits: int) -> list[int]:
    """Of each key: the bits on which its fingerprints agree."""
    segs, out = ring(max_bits), []
    for i, (shift, width) in enumerate(segs):
        s, w = segs[(i + 1) % len(segs)]
        out += [_mask(shift, width) | _mask(s, w // 2), _mask(shift, width) | _mask(s + w // 2, w - w // 2)]
    return out


def chain_masks(max_bits: int) -> list[list[tuple[int, int]]]:
    """For each start: (bits of the l first segments, their budget) for l = 2 to m."""
    segs = ring(max_bits)
    m = len(segs)
    out = []
    for i in range(m):
        bits, chain = _mask(*segs[i]), []
        for n in range(2, m + 1):
            bits |= _mask(*segs[(i + n - 1) % m])
            chain.append((bits, n * max_bits // m))
        out.append(chain)
    return out


def _near(x: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Positions whose differences x keep every budget of the chain; the last is the full check."""
    at = np.arange(len(x))
    for bits, budget in chain:
        at = at[np.bitwise_count(x[at] & np.uint64(bits)) <= budget]
    return at


def _forest(fps: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spanning forest of the links among one key's fingerprints."""
    rest, out = fps, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            hit = _near(rest ^ p, chain)
            if len(hit):
                out += [(int(p), int(q)) for q in rest[hit]]
                todo += list(rest[hit])
                rest = np.delete(rest, hit)
    return out


def _links_in_keys(max_bits: int, key_limit: int):
    chains = chain_masks(max_bits)
    small = 8

    def link(which: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        """Whole runs of equal (which, key), sorted; returns (a, b) columns."""
        a, b = [], []
        new = np.concatenate(([True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        run = np.cumsum(new) - 1
        few = sizes[run] <= small
        for d in range(1, small):
            i = np.flatnonzero((run[d:] == run[:-d]) & few[d:])
            for s, chain in enumerate(chains):
                j = i[which[i] // 2 == s]
                j = j[_near(fp[j] ^ fp[j + d], chain)]
                a.append(fp[j])
                b.append(fp[j + d])
        for r in np.flatnonzero(sizes > small):
            lo = starts[r]
            pairs = _forest(fp[lo:lo + sizes[r]], chains[which[lo] // 2])
            if pairs:
                x = np.array(pairs, dtype=np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        return [np.concatenate(a), np.concatenate(b)] if a else [np.empty(0, np.uint64)] * 2

    def rows(a: np.ndarray, b: np.ndarray, hot: bool = False) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if hot else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        over = None  # the key that has passed the limit
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            new[2] = new[2].view(np.uint64)
            cols = [np.concatenate(x) for x in zip(held, new)]
            if not len(cols[0]):
                continue
            if over is not None:
                same = (cols[0] == over[0]) & (cols[1] == over[1])
                if same.any():
                    yield rows(cols[2][same], cols[2][same], hot=True)
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    held = cols
                    continue
                over = None
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            done, held = [c[~last] for c in cols], [c[last] for c in cols]
            if len(held[0]) > key_limit:
                over = (held[0][0], held[1][0])
                yield rows(held[2], held[2], hot=True)
                held = [c[:0] for c in held]
            if len(done[0]):
                yield rows(*link(*done))
        if len(held[0]):
            yield rows(*link(*held))

    return run


def _meeting_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links of the fingerprints of overfull keys by common middle values."""
    reach = (max_bits + 1) // 2
    flips = [_signed(sum(1 << b for b in c)) for n in range(reach + 1) for c in combinations(range(BITS), n)]
    met = hot.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    if max_bits % 2 == 0:
        least = met.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
        return met.join(least, "middle").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    # t odd: one side may be a bit nearer, so the middle is kept with its distance
    met = met.withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
    least = met.groupBy("middle").agg(F.min(F.when(F.col("far") < reach, F.col("fp"))).alias("b")).filter("b is not null")
    return met.join(least, "middle").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(distinct_fps: DataFrame, max_bits: int = 4, key_limit: int = 20000) -> DataFrame:
    """(a, b): links between distinct fingerprints that have the same components
    as all links. distinct_fps: column fp."""
    none = "a long, b long"
    if max_bits == 0:
        return distinct_fps.sparkSession.createDataFrame([], none)
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(key_masks(max_bits))])
    filed = distinct_fps.select(F.explode(keys).alias("k"), "fp").select("k.which", "k.key", "fp")
    found = staged(filed.repartition("which", "key").sortWithinPartitions("which", "key", "fp")
                   .mapInArrow(_links_in_keys(max_bits, key_limit), none).distinct(), "simhash-links")
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return found
    return found.filter("b is not null").unionByName(_meeting_links(hot, max_bits))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the
    smallest node reachable. Large-star and small-star in turn until nothing
    changes; each round is a table in the shared folder."""
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = staged(small.filter("u <> v").distinct(), "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, key_limit: int = 20000) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_fp, text_hash), one row for each
    document. class_fp names the class also where its ids are null."""
    fps = staged(fingerprints(docs, shingle), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), max_bits, key_limit))
    named = classes.join(roots, classes.fp == roots.node, "left").select(
        classes.fp.alias("cfp"), "least", F.coalesce("root", classes.fp).alias("class_fp"))
    ids = named.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    members = named.join(ids, "class_fp").select("cfp", "class_fp", "component_id")
    return fps.join(members, fps.fp == members.cfp).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_fp", "text_hash")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id, and
    of repeated rows one. Among null ids the smallest text hash decides."""
    order = lambda i: F.coalesce(i.cast("long"), F.lit(-(1 << 63)))
    one = near_duplicates(docs, shingle, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        "class_fp").agg(F.min(F.struct(order(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__th"))).alias("o"))
    keyed = docs.select("*", order(F.col("doc_id")).alias("__id"), F.xxhash64("text").alias("__th"))
    kept = keyed.join(one.select("o.*"), ["__id", "__th"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("__id", "__th").orderBy("__id"))
    return kept.withColumn("__n", nth).filter("__n = 1").drop("__n", "__id", "__th")
