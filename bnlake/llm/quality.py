"""Quality rules: text measures, and cross-document line frequency. DataFrame
functions only.

Lines are normalised (lower case, white space to one space, trimmed) and hashed
with their host. A host's line is counted once for each different text of the
host that holds it, so exact copies of one document are one document. A line is
removed where the count reaches ``min_texts`` and also ``min_share`` of the
host's different texts. A document is depleted, and rejected, if the words of
its removed lines are more than ``max_removed`` of its words; what is left then
is mostly boilerplate.

Null text has no words, null host is a host of its own, empty lines count for
nothing. Repeated rows get the same result each. Equality of windows, lines and
texts inside the counts is equality of their 64-bit XXH64 values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnlake.llm.common import WORD_GAP, words

GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT = 5


@dataclass(frozen=True)
class LineLimits:
    min_texts: int = 20
    min_share: float = 0.01
    max_removed: float = 0.75


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def window_hashes(w: Column) -> Column:
    """Hash of every 5-word window.
    w: a stored column of words."""
    n = F.size(w)
    return F.when(n < REPEAT, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*[w[i + k] for k in range(REPEAT)])))


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def sizes(p: Column) -> Column:
        # p: hashes in order with their positions; neighbours tell which repeat
        n = F.size(p)
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(p, 1, n - 1))
        after = F.concat(F.slice(p, 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        marked = F.zip_with(F.zip_with(p, before, lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), (x["h"] == y["h"]).alias("b"))), after,
                            lambda x, y: F.when(F.coalesce(x["b"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))
        at = F.sort_array(F.array_compact(marked))
        nothing = F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, nothing, lambda s, i: F.struct(
            i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(REPEAT))).cast("long").alias("n")), lambda s: s["n"])

    # an array of one value binds the sorted windows once for all their uses
    return F.transform(F.array(placed), sizes)[0]


def measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and the kept columns."""
    text = F.col("__text")
    base = docs.select("doc_id", _text(F.col("text")).alias("__text"), *keep)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAPS, "") != "")
    counted = base.select(
        "doc_id", *keep, words(text).alias("__w"), lines.alias("__lines"),
        F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    hashed = counted.select(
        "*", F.size("__w").cast("long").alias("n_words"), window_hashes(F.col("__w")).alias("__h"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    repeated = F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0).cast("long")).otherwise(_covered(F.col("__h")))
    out = hashed.select("*", repeated.alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a later filter must not move below this point: it would put the whole
    # computation of the arrays into its condition, once for each element
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))
    return out.select("doc_id", *keep, F.explode(F.array(found)).alias("__m")).select("doc_id", *keep, "__m.*")


def line_key(line: Column) -> Column:
    """Normalised line; empty if it has no word."""
    return F.lower(F.trim(F.regexp_replace(line, WORD_GAP, " ")))


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each different normalised line of each row of docs: doc_id, th
    (hash of the text), host, key (hash of host and line), words (of all its
    occurrences there)."""
    pairs = F.filter(F.transform(F.split(_text(F.col("text")), "\n"), lambda x: F.struct(
        line_key(x).alias("line"), F.size(words(x)).alias("n"))), lambda s: s["line"] != "")
    split = docs.select("doc_id", "host", F.xxhash64("text").alias("th"), F.explode(pairs).alias("s"))
    key = F.xxhash64(F.coalesce("host", F.lit("")), F.isnull("host"), F.col("s.line"))
    return split.select("doc_id", "th", "host", key.alias("key"), F.col("s.n").alias("words"))


def frequent_lines(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """(key, texts): host lines above the limits."""
    lines = document_lines(docs).select("host", "key", "th").distinct()
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("texts")).filter(F.col("texts") >= limits.min_texts)
    hosts = docs.select(F.col("host").alias("h"), F.xxhash64("text").alias("th")).distinct().groupBy("h").agg(
        F.count("*").alias("of"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(
        F.col("texts") >= limits.min_share * F.col("of")).select("key", "texts")


def removed_lines(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """(doc_id, th, n_line_words, lines): words under removed lines of each
    document that has any, and the keys of those lines."""
    lines = document_lines(docs).select("doc_id", "th", "key", "words")
    hit = lines.join(frequent_lines(docs, limits).select("key"), "key", "left_semi")
    # rows that repeat a document repeat its lines: a document's occurrences of a
    # line are summed first and then divided by the number of its rows
    rows = docs.groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.count("*").alias("copies"))
    by_doc = hit.groupBy("doc_id", "th").agg(F.sum("words").alias("words"), F.collect_set("key").alias("lines"))
    b = by_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "words", "lines")
    return rows.join(b, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select(
        "doc_id", "th", (F.col("words") / F.col("copies")).cast("long").alias("n_line_words"), "lines")


def judge(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The measures, n_line_words (under removed lines), depleted and kept; one
    row for each document."""
    base = docs.select("doc_id", "text", F.col(host).alias("host"))
    found = removed_lines(base, limits).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_line_words")
    m = measures(base.withColumn("th", F.xxhash64("text")), keep=("th",))
    joined = m.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").withColumn(
        "n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    depleted = F.col("n_line_words") > limits.max_removed * F.col("n_words")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~depleted).alias("kept"), "n_line_words", depleted.alias("depleted"))


def filter_documents(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """docs without the rejected documents; frequent lines are cut from the others."""
    base = docs.select("doc_id", "text", F.col(host).alias("host"))
    found = removed_lines(base, limits).select(
        F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("n_line_words").alias("__n"), F.col("lines").alias("__lines"))
    names = docs.columns
    rows = docs.select(*names, F.xxhash64("text").alias("__th"), F.col("doc_id").alias("__id"))
    checked = measures(base.withColumn("th", F.xxhash64("text")), keep=("th",)).filter(~F.col("base_failed")).select(
        F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("n_words").alias("__words")).distinct()
    good = checked.join(found.withColumnsRenamed({"__d": "__fd", "__t": "__ft"}),
                        F.col("__d").eqNullSafe(F.col("__fd")) & (F.col("__t") == F.col("__ft")), "left").filter(
        F.coalesce("__n", F.lit(0)) <= limits.max_removed * F.col("__words")).select("__d", "__t", "__lines")
    joined = rows.join(good, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")))
    h = F.col(host)
    gone = lambda x: F.array_contains("__lines", F.xxhash64(F.coalesce(h, F.lit("")), F.isnull(h), line_key(x)))
    cut = F.when(F.size("__lines") > 0, F.array_join(F.filter(F.split("text", "\n"), lambda x: ~gone(x)), "\n")).otherwise(F.col("text"))
    return joined.select(*[cut.alias(c) if c == "text" else F.col(c) for c in names])
