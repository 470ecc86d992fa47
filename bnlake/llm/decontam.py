"""Benchmark decontamination: size-partitioned MinHash containment search,
verified by exact shingle containment. DataFrame functions only.

Texts become runs of letters and digits in lower case and their ``shingle``-word
shingles. An item is leaked by a document that holds at least ``threshold`` of
its different shingles.

Items are partitioned by size, into classes of n different shingles from 2^j up
to 2^(j+1) - 1. The MinHash sketch of an item is its k smallest shingle hashes,
with k one above the shingles that an item of the class's largest size may miss:
a document that holds ``threshold`` of the item holds one of the k at least, so
the search misses nothing. Every document's shingles are probed against the
sketches; candidates are then verified by comparing shingle texts.

The sketches are broadcast if they have at most ``broadcast_rows`` rows (24 bytes
each); beyond that the probe is a shuffled join.

Items with fewer words than the shingle length use shingles as long as the
item. Items and documents without a word, and null texts, match nothing.
Repeated rows of an id count as one; null is an id like any other, of documents
and of items, as in the query's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words here: anything but letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(w: Column, n: int) -> Column:
    """Texts of all runs of n words."""
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))


def _hashes(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, from the hashes of the words."""
    return F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)])))


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(item_id, n, h, text, of): the different shingles of each item; n words
    each, of: how many the item has."""
    w = items.select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    parts = w.select("item_id", F.explode(F.when(F.size("w") < shingle, F.array(F.array_join("w", " "))).otherwise(
        _shingles(F.col("w"), shingle))).alias("text"), F.least(F.size("w"), F.lit(shingle)).alias("n")).distinct()
    sized = parts.groupBy("item_id").agg(F.count("*").alias("of"), F.collect_list(F.struct("n", "text")).alias("s"))
    each = sized.select("item_id", "of", F.explode("s").alias("s")).select("item_id", "of", "s.n", "s.text")
    return each.withColumn("h", F.xxhash64(F.transform(F.split("text", " "), lambda x: F.xxhash64(x))))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, n, h): the smallest hashes of each item, as many as its size class needs."""
    top = F.pow(F.lit(2), F.floor(F.log2("of")) + 1) - 1
    k = (top - F.ceil(F.round(top * threshold, 6)) + 1).cast("int")
    by = shingles.groupBy("item_id", "n", "of").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    return by.select("item_id", "n", F.explode(F.slice("hs", 1, k)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5,
          broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): every pair at or
    above the threshold."""
    spark = docs.sparkSession
    known = item_shingles(items, shingle)
    sketch = sketches(known, threshold)
    sizes = [(r["n"], r["rows"]) for r in sketch.groupBy("n").agg(F.count("*").alias("rows")).collect()]  # at most `shingle` rows
    out = None
    for n, rows in sorted(sizes):
        small = rows <= broadcast_rows
        near = F.broadcast if small else (lambda x: x)
        probe = sketch.filter(F.col("n") == n).select("item_id", "h")
        hashed = docs.select("doc_id", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
        each = hashed.select("doc_id", F.explode(_hashes(F.col("w"), n)).alias("h"))
        found = each.join(near(probe.select("h").distinct()), "h", "left_semi").distinct()
        candidates = found.join(probe, "h").select("doc_id", "item_id").distinct()
        # exact: the texts of the candidates' shingles
        texts = docs.join(candidates.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        # the words are a column of their own: inside a lambda they would be split again for every shingle
        split = texts.select("doc_id", tokens(F.col("text")).alias("w"))
        said = split.select("doc_id", F.explode(F.array_distinct(_shingles(F.col("w"), n))).alias("text"))
        mine = known.filter(F.col("n") == n).select("item_id", "text", "of")
        both = said.join(near(mine) if small else mine, "text").select("doc_id", "item_id", "of", "text").distinct()
        counts = both.groupBy("doc_id", "item_id", "of").agg(F.count("*").alias("n_found"))
        pairs = candidates.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
        sure = counts.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi").filter(
            F.col("n_found") >= F.round(threshold * F.col("of"), 6))
        part = sure.select("doc_id", "item_id", F.col("of").alias("n_shingles"), "n_found",
                           (F.col("n_found") / F.col("of")).alias("containment"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        item = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, item_id {item}, n_shingles long, n_found long, containment double")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs without those that leak an item. A null doc_id can't be named by a
    leak, so such rows are judged under their text's hash."""
    names = docs.columns
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    rows = docs.select(*names, key.alias("__key"))
    found = leaks(rows.select(F.col("__key").alias("doc_id"), "text"), items, threshold, shingle)
    bad = found.select(F.col("doc_id.id").alias("__d"), F.col("doc_id.th").alias("__t")).distinct()
    return rows.join(bad, F.col("__key.id").eqNullSafe(F.col("__d")) & (F.col("__key.th") == F.col("__t")), "left_anti").select(*names)
