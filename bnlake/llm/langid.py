"""Language ID by compression: a text is compressed with one raw-content
zstandard dictionary for each language, and the smallest result wins.

The dictionaries are learned from a bounded sample of labelled rows: of each
language the ``sample_rows`` documents with the smallest id hash in as many hash
buckets, of each an excerpt of ``sample_words`` words, or ``sample_chars``
characters if that is less, at a place that the hash chooses. Every language is learned; with more than
``max_langs`` of them, each has fewer rows, so that all together have no more than max_langs * sample_rows.
Predictions read the text alone, always whole; before compressing, letters are
lower-cased and everything else becomes one space.

Equal sizes are decided by the share of the text's different words that the
dictionary holds, then by the language's name. score is the margin: the part of
the second smallest size that the smallest saves (1 if one language is known).
A prediction with a margin below ``min_margin`` is rejected: accepted is false,
while lang_pred still names the nearest language.

Null text, and text without a letter: ``und``, score 0, not accepted. Without
any labelled row all predictions are ``und``. Rows without an id or a language
are not learned from. Repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnlake.llm.common import words

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def normal(text: str | None) -> str:
    found = LETTERS.findall((text or "").lower())
    joined = " ".join(found)
    return joined if any(c.isalpha() for c in joined) else ""


def learn(rows: DataFrame, sample_rows: int = 512, sample_words: int = 60, sample_chars: int = 1000,
          max_langs: int = 256) -> dict[str, bytes]:
    """Dictionary of each language from rows (doc_id, text, lang); at most
    max_langs * sample_rows excerpts reach the driver, or one a language if that is more."""
    known = rows.filter("doc_id is not null and lang is not null").select(
        "doc_id", "lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("hash"))
    n_langs = known.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(sample_rows, max_langs * sample_rows // max(1, n_langs)))
    bucket = F.pmod("hash", F.lit(each)).alias("bucket")
    chosen = known.groupBy("lang", bucket).agg(F.min("hash").alias("hash")).select("lang", "hash")
    w = words(F.col("text"))
    span = F.greatest(F.size("w") - sample_words, F.lit(0)) + 1
    excerpt = F.substring(F.array_join(F.slice("w", (F.pmod("hash", span) + 1).cast("int"), sample_words), " "), 1, sample_chars)
    # the chosen rows are at most max_langs * sample_rows, or one a language
    got = known.join(F.broadcast(chosen), ["lang", "hash"]).select("lang", "hash", w.alias("w")).select(
        "lang", "hash", excerpt.alias("text")).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["hash"], r["text"])):
        if t := normal(r["text"]):
            out.setdefault(r["lang"], []).append(t)
    return {lang: " ".join(parts).encode() for lang, parts in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.langs = sorted(dictionaries)
        self.words = [set(dictionaries[x].split()) for x in self.langs]
        self.by = []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        """Language, margin and the runner-up."""
        t = normal(text).encode()
        if not t or not self.langs:
            return UND, 0.0, None
        sizes = [len(c.compress(t)) for c in self.by]
        least = min(sizes)
        best = [i for i, s in enumerate(sizes) if s == least]
        if len(best) > 1:
            own = set(t.split())
            best.sort(key=lambda i: (-len(own & self.words[i]), self.langs[i]))
        if len(sizes) == 1:
            return self.langs[0], 1.0, None
        rest = min((s, self.langs[i]) for i, s in enumerate(sizes) if i != best[0])
        return self.langs[best[0]], (rest[0] - least) / rest[0], rest[1]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 6, min_margin: float = 0.02) -> DataFrame:
    """(doc_id, lang_pred, score, accepted, second) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, level)
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[0] != UND and g[1] >= min_margin for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.string())],
                ["doc_id", "lang_pred", "score", "accepted", "second"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, accepted boolean, second string")


def identify_documents(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the rows that aren't held out, predict all; adds held_out."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs, model, **settings)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "second")
