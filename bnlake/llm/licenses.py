"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the
nearest ancestor directory by path joins. DataFrame functions only.

A file's units are its lines (headers) and, if its name is that of a licence
file, also its whole text. With ``runs``, runs of neighbouring lines are headers
too: from each line with a term of a template on, as many terms as that has,
compared with it. For templates of more than ``LONG`` terms a run begins at the first
line or after a line without terms.
A unit's licence is that of the template with the largest cosine, if that is at
least ``threshold``. A term weighs its count times
idf = ln((1 + N) / (1 + df)) + 1, with df counted over all N files for
every term, whether a template has it or not.

Units are found by prefix filtering, which loses none: a cosine of ``threshold``
needs one of the template's rarest terms, those left when the commonest with
less than threshold^2 of its squared length are set aside, and a file whose
terms cover threshold^2 of the template's squared length. The same bound, summed
over its lines, is asked of a run before its terms are cut out.

A file's own licence is its best unit's. A licence file with a licence gives it
to its directory; files without their own take that of the nearest directory
above them that has one.

The templates are a parameter, several for a licence if need be (default:
``licence_library``); their terms (``max_terms`` at most) are the only
thing that reaches the driver. Null text has no units, null path no directory;
ties go to the smaller licence name. Rows that repeat a path are files of their
own. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bnlake.llm.common import staged
from bnlake.llm.licence_library import library

# Short public licence statements.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
WORD_GAP = "[^a-z0-9]+"
#: Templates of more terms are looked for from the first line of a paragraph on.
LONG = 400
#: Different terms of candidate units up to which they are broadcast (some 30 bytes each).
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def _terms(text: str) -> list[str]:
    return [t for t in re.split(WORD_GAP, text.lower()) if t]


def _in(words: Sequence[str]) -> str:
    """SQL list of terms, parsed at once; as a column each would be a call to the JVM."""
    return ", ".join(f"'{t}'" for t in words) or "null"


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """(dir, depth) of the directory and all above it; the top is empty, with depth 0."""
    parts = F.split(folder, "/")
    return F.concat(F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth"))), F.when(
        folder == "", F.array().cast("array<struct<dir:string,depth:int>>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))))


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, df): in how many files each term occurs, as a stored table."""
    found = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return staged(found.groupBy("term").agg(F.count("*").alias("df")), "licence-df")


def template_idf(df: DataFrame, n: int, vocabulary: list[str]) -> dict[str, float]:
    """idf of the templates' terms over n files; at most as many rows reach the driver."""
    known = {r["term"]: r["df"] for r in df.filter(F.expr(f"term IN ({_in(vocabulary)})")).collect()}
    return {t: math.log((1 + n) / (1 + known.get(t, 0))) + 1 for t in vocabulary}


def template_vectors(templates: Sequence[tuple[str, str]], idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors, one for each template."""
    out = []
    for _, text in templates:
        v = {t: c * idf[t] for t, c in Counter(_terms(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out


def needed_terms(vector: dict[str, float], threshold: float, idf: dict[str, float]) -> list[str]:
    """The rarest terms of which a unit at the threshold has at least one."""
    common = 0.0
    out = []
    for t, x in sorted(vector.items(), key=lambda p: (idf[p[0]], p[0])):
        common += x * x
        if common >= threshold * threshold - 1e-9:
            out.append(t)
    return out


def header_runs(may: DataFrame, pairs: DataFrame, sides: DataFrame, lengths: DataFrame, threshold: float) -> DataFrame:
    """(file, unit, w): runs of neighbouring lines as long as a template that the file may hold.
    may: (file, text); pairs: (file, template); sides: (term, template, w); lengths: (template, terms)."""
    held = pairs.groupBy("file").agg(F.collect_set("template").alias("templates"))
    # dealt by file once: a file's lines, sums and windows stay together
    lines = may.select("file", "text").join(held, "file").repartition("file").select(
        "file", "templates", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("file", "templates", "at", terms(F.col("line")).alias("w"))
    by = Window.partitionBy("file").orderBy("at")
    n = F.size("w")
    placed = lines.withColumns({"n": n, "begin": F.sum(n).over(by) - n, "opens": F.coalesce(F.lag(n).over(by), F.lit(0)) == 0})
    # a line's part of the squared length of the templates that its file may hold, repetitions counted
    said = placed.select("file", "templates", "at", "n", "begin", "opens", F.explode("w").alias("term")).join(sides, "term")
    parts = said.filter(F.array_contains("templates", F.col("template"))).groupBy("file", "at", "n", "begin", "opens", "template").agg(
        F.sum(F.col("w") * F.col("w")).alias("part"))
    # a run's lines are those that begin within its length
    unit = 1 << 32
    reach = Window.partitionBy("file", "template").orderBy(F.floor(F.col("begin") * unit / F.col("terms"))).rangeBetween(0, unit)
    starts = parts.join(lengths, "template").withColumn("run", F.sum("part").over(reach)).filter(
        (F.col("run") >= threshold * threshold - 1e-6) & (F.col("n") < F.col("terms")) & ((F.col("terms") <= LONG) | F.col("opens")))
    whole = may.select("file", terms(F.col("text")).alias("w"))
    return starts.join(whole, "file").select(
        "file", F.struct(F.lit(0).alias("whole"), "at", "template").alias("unit"),
        F.slice("w", (F.col("begin") + 1).cast("int"), F.col("terms")).alias("w"))


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] | None = None, threshold: float = 0.8,
         max_terms: int = 50_000, keep: tuple[str, ...] = (), runs: bool = False) -> DataFrame:
    """(path, kept columns, licence, how, score) for each row of files (path,
    text): how is header, file, inherited or null."""
    if templates is None:
        templates = library(TEMPLATES)
    vocabulary = sorted({t for _, text in templates for t in _terms(text)})
    if not vocabulary or len(vocabulary) > max_terms:
        raise ValueError("templates need at least one term, and at most max_terms different ones")
    n = files.count()
    df = document_frequencies(files)
    idf = template_idf(df, n, vocabulary)
    vectors = template_vectors(templates, idf)
    needs = [needed_terms(v, threshold, idf) for v in vectors]
    needed = sorted({t for n in needs for t in n})
    spark = files.sparkSession
    # templates times their terms
    sides = F.broadcast(spark.createDataFrame(
        [(t, i, templates[i][0], float(x)) for i, v in enumerate(vectors) for t, x in sorted(v.items())],
        "term string, template int, licence string, w double"))
    lengths = F.broadcast(spark.createDataFrame([(i, len(_terms(text))) for i, (_, text) in enumerate(templates)], "template int, terms int"))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    # 128 bits of path and text
    gone = F.col("path").isNull()
    file_key = F.struct(F.xxhash64("path", gone, "text").alias("a"), F.xxhash64("text", gone, "path").alias("b"))
    has = F.expr(f"exists(w, t -> t IN ({_in(needed)}))")
    texts = files.select(file_key.alias("file"), "path", named.alias("named"), F.coalesce("text", F.lit("")).alias("text"))
    some = texts.withColumn("w", terms(F.col("text"))).filter(has).select("file", "path", "named", "text", "w")
    # a cosine is at most the length of the template's part that the file has terms of; rows that
    # repeat a file count its terms again, which only lets more pairs through
    held = some.select("file", F.explode(F.array_distinct(F.expr(f"filter(w, t -> t IN ({_in(vocabulary)}))"))).alias("term"))
    pairs = held.join(sides, "term").groupBy("file", "template").agg(F.sum(F.col("w") * F.col("w")).alias("part")).filter(
        F.col("part") >= threshold * threshold - 1e-6).select("file", "template")
    pairs = staged(pairs, "licence-pairs")
    may = staged(some.join(pairs.select("file").distinct(), "file", "left_semi").dropDuplicates(["file"]), "licence-files")
    lines = may.select("file", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("file", "at", terms(F.col("line")).alias("w"))
    single = lines.filter(has).select("file", F.struct(F.lit(0).alias("whole"), "at", F.lit(-1).alias("template")).alias("unit"), "w")
    units = single.unionByName(may.filter("named").select(
        "file", F.struct(F.lit(1).alias("whole"), F.lit(0).alias("at"), F.lit(-1).alias("template")).alias("unit"), "w"))
    if runs:
        units = units.unionByName(header_runs(may, pairs, sides, lengths, threshold))
    # dealt by file, so that the sums over a unit combine before they are shuffled
    counted = staged(units.repartition("file").select("file", "unit", F.explode("w").alias("term")).groupBy("file", "unit", "term").agg(
        F.count("*").alias("tf")), "licence-units")
    # every term of a unit is in a file, so none is lost
    said = counted.select("term").distinct()
    few = F.broadcast if said.count() <= BROADCAST_TERMS else (lambda table: table)
    used = few(df.join(few(said), "term", "left_semi").select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    weighed = counted.join(used, "term").select("file", "unit", "term", (F.col("tf") * F.col("idf")).alias("x"))
    size = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = weighed.join(sides, "term").filter((F.col("unit.template") == -1) | (F.col("unit.template") == F.col("template"))).groupBy("file", "unit", "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(size, ["file", "unit"]).select("file", "unit", "licence", F.round(F.col("dot") / F.col("size"), 6).alias("score"))
    # the best of a file: largest score, then the smaller name, then a header before the whole text
    order = F.struct((-F.col("score")).alias("s"), "licence", F.col("unit.whole").alias("whole"))
    own = staged(scored.filter(F.col("score") >= threshold).groupBy("file").agg(F.min(order).alias("b")).select(
        "file", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("own_score"),
        F.when(F.col("b.whole") == 1, "file").otherwise("header").alias("own_how")), "licences")
    dirs = own.join(may.filter("named").select("file", "path"), "file").groupBy(directory(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("licence"))).alias("b")).select("dir", "b.licence", (-F.col("b.s")).alias("dscore"))
    # directories once each, so that a directory of many files joins as one row
    folders = files.select(directory(F.col("path")).alias("folder")).filter("folder is not null").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.dir", "a.depth")
    near = above.join(dirs, "dir").groupBy("folder").agg(F.max(F.struct("depth", "licence", "dscore")).alias("n")).select(
        F.col("folder").alias("nf"), F.col("n.licence").alias("up"), F.col("n.dscore").alias("up_score"))
    rows = files.select("path", *keep, file_key.alias("__file"), directory(F.col("path")).alias("folder"))
    joined = rows.join(own, F.col("__file") == F.col("file"), "left").join(near, F.col("folder") == F.col("nf"), "left")
    return joined.select("path", *keep, F.coalesce("own", "up").alias("licence"), F.coalesce(
        "own_how", F.when(F.col("up").isNotNull(), F.lit("inherited"))).alias("how"), F.coalesce("own_score", "up_score").alias("score"))
