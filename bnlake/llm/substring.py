"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words.

A word goes if a window that covers it also starts earlier, that is in a smaller
doc_id or before it in the same document; windows are judged on the input.

1. Every window's Rabin-Karp hash is formed; of each window only the smallest
   hash among its runs of ``gram`` words (its minimiser) is counted in Spark.
   Equal windows have equal minimisers, so a window whose minimiser is counted
   once is not repeated, and nothing is lost.
2. The windows with a repeated minimiser are grouped by their own 64-bit hash;
   each that is not the first of its group is a removal.
3. Removals of a document merge into maximal intervals, applied to its words.

A task first merges the equal hashes of a block of documents into one row with
lists, so a passage found in a third of all documents gives one row a block.
No step holds more than a block, a document, or one hash's rows.

Null or empty text: no words, empty kept text. Texts shorter than a window lose
nothing. Rows that share an id are documents of their own, ordered by their texts'
hashes; rows that share both are one document: windows at the same start are not
earlier. A null doc_id counts as smaller than every other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bnlake.llm.common import byte_texts, staged

#: Multiplier of the polynomial (odd, so that no power of it vanishes modulo 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words in a block of documents whose equal hashes one task merges.
BLOCK_WORDS = 1_000_000
NULL_ID = -(1 << 63)
#: Ids that several rows share, up to which they are broadcast.
BROADCAST_IDS = 200_000


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= BASE
        acc += h[j:j + m]
    return acc


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    have = 1
    while have * 2 <= n:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:len(a) - (n - have)], a[n - have:]) if have < n else a


class Windows:
    """Windows of a block of documents: hash, minimiser, document and start."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        doc = np.repeat(np.arange(len(split)), sizes)
        start = np.arange(len(h)) - first[doc] if len(h) else np.empty(0, np.int64)
        m = max(0, len(h) - window + 1)
        whole = np.flatnonzero(doc[:m] == doc[len(h) - m:]) if m else np.empty(0, np.int64)
        grams = rolling(h, gram) * MIX
        grams ^= grams >> np.uint64(29)
        least = sliding_min(grams, window - gram + 1) if m else grams[:0]
        self.hash = rolling(h, window)[whole]
        self.least, self.doc, self.start = least[whole], doc[whole], start[whole]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Documents (id, tie, text, more ...) in blocks of bounded words."""
    rows, size = [], 0
    for b in batches:
        rest = [b.column(i).to_pylist() for i in range(3, b.num_columns)]
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), *rest):
            rows.append((NULL_ID if row[0] is None else row[0], row[1], row[2] or b"", *row[3:]))
            size += len(row[2] or b"") // 6
            if size >= BLOCK_WORDS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _grouped(key: np.ndarray, order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by key, then order; where each key begins."""
    at = np.lexsort((*order[::-1], key))
    k = key[at]
    return at, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else at


def _minimisers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            w = Windows([r[2] for r in rows], window, gram)
            if not len(w.hash):
                continue
            ids, ties = _keys(rows)
            # minimisers of windows that repeat inside this block count twice
            at = np.argsort(w.hash, kind="stable")
            same = w.hash[at[1:]] == w.hash[at[:-1]]
            twice = np.unique(w.least[at[1:][same]])
            new = np.concatenate(([True], (w.least[1:] != w.least[:-1]) | (w.doc[1:] != w.doc[:-1])))
            least, doc, tie = w.least[new], ids[w.doc[new]], ties[w.doc[new]]
            at, begin = _grouped(least, (doc, tie))
            least, doc, tie = least[at], doc[at], tie[at]
            keep = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
            least, doc, tie = least[keep], doc[keep], tie[keep]
            begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            key = least[begin]
            docs = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()),
                                            pa.StructArray.from_arrays([pa.array(doc), pa.array(tie)], ["d", "t"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(1 + np.isin(key, twice).astype(np.int32)), docs], ["h", "n", "docs"])

    return run


def _keys(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _suspects(window: int, gram: int):
    """Windows whose minimiser is among the document's repeated ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            rows = [r for r in rows if r[3]]
            if not rows:
                continue
            ids, ties = _keys(rows)
            w = Windows([r[2] for r in rows], window, gram)
            hit = np.zeros(len(w.hash), bool)
            edge = np.searchsorted(w.doc, np.arange(len(rows) + 1))
            for i, r in enumerate(rows):
                a, b = edge[i], edge[i + 1]
                hit[a:b] = np.isin(w.least[a:b], np.array(r[3], np.int64).view(np.uint64))
            key, doc, tie, start = w.hash[hit], ids[w.doc[hit]], ties[w.doc[hit]], w.start[hit].astype(np.int32)
            if not len(key):
                continue
            at, begin = _grouped(key, (doc, tie, start))
            key, doc, tie, start = key[at], doc[at], tie[at], start[at]
            # the block's earliest in columns, the others in a list; most have none
            others = np.ones(len(key), bool)
            others[begin] = False
            more = np.diff(np.append(begin, len(key))) - 1
            places = pa.StructArray.from_arrays([pa.array(x[others]) for x in (doc, tie, start)], ["d", "t", "s"])
            ends = pa.array(np.concatenate(([0], np.cumsum(more))), pa.int32())
            found = pa.RecordBatch.from_arrays(
                [pa.array(key[begin].view(np.int64)), pa.array(doc[begin]), pa.array(tie[begin]), pa.array(start[begin]),
                 pa.ListArray.from_arrays(ends, places, mask=pa.array(more == 0))], ["w", "d", "t", "s", "more"])
            # in the order of the texts, documents and starts shuffle in fewer bytes
            yield found.take(pa.array(np.argsort(at[begin], kind="stable")))

    return run


def intervals(starts: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Maximal removal intervals [from, to) of repeated windows."""
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts or ())):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, starts in zip(byte_texts(b.column(1)), b.column(2).to_pylist()):
                w = (text or b"").split()
                gone = intervals([s for s in starts or () if s + window <= len(w)], window)
                rest, at = [], 0
                for lo, hi in gone:
                    rest += w[at:lo]
                    at = hi
                rest += w[at:]
                n_words.append(len(w))
                n_removed.append(len(w) - len(rest))
                spans.append([{"from": lo, "to": hi} for lo, hi in gone])
                kept.append(b" ".join(rest))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string()),
                 *[b.column(i) for i in range(3, b.num_columns)]],
                ["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256",
                 *[b.schema.names[i] for i in range(3, b.num_columns)]])

    return run


def _tied(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(__id, __t, text, carried): __t tells apart rows that share an id. It is the text's
    hash, and 0 for ids of one row, which shuffles in fewer bytes."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__id")
    rows = docs.select(key, F.xxhash64("text").alias("__t"), "text", *[F.col(c) for c in carry])
    shared = staged(docs.select(key).groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("__id").alias("__shared")), "shared-ids")
    if shared.count() > BROADCAST_IDS:
        return rows
    rows = rows.join(F.broadcast(shared), F.col("__id") == F.col("__shared"), "left")
    return rows.withColumn("__t", F.when(F.col("__shared").isNotNull(), F.col("__t")).otherwise(F.lit(0))).drop("__shared")


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text, kept_sha256) and the
    carried columns, one row for each document."""
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    rows = _tied(docs, carry)
    base = rows.select("__id", "__t", "text")
    counted = base.mapInArrow(_minimisers(window, gram), "h long, n int, docs array<struct<d: long, t: long>>")
    total = F.sum("n").over(Window.partitionBy("h"))
    hits = (counted.withColumn("total", total).filter("total > 1").select(F.explode("docs").alias("p"), "h")
            .groupBy(F.col("p.d").alias("__id"), F.col("p.t").alias("__t")).agg(F.collect_list("h").alias("hits")))
    place = "struct<d: long, t: long, s: int>"
    suspects = base.join(hits, ["__id", "__t"], "left").select("__id", "__t", "text", "hits").mapInArrow(
        _suspects(window, gram), f"w long, d long, t long, s int, more array<{place}>")
    # only a block's earliest can be the earliest of all
    head = F.struct("d", "t", "s")
    judged = suspects.withColumn("first", F.min(head).over(Window.partitionBy("w"))).filter((head != F.col("first")) | F.col("more").isNotNull())
    places = F.concat(F.array(head), F.coalesce("more", F.array().cast(f"array<{place}>")))
    gone = (judged.select(F.explode(F.filter(places, lambda p: p != F.col("first"))).alias("p"))
            .groupBy(F.col("p.d").alias("__id"), F.col("p.t").alias("__t")).agg(F.collect_list("p.s").alias("starts")))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = rows.join(gone, ["__id", "__t"], "left").select("__id", "text", "starts", *carry).mapInArrow(
        _keep(window), "doc_id long, n_words long, n_removed long, removed array<struct<from: long, to: long>>, "
        "kept_text string, kept_sha256 string" + (", " + kinds if kinds else ""))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
