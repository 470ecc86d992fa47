"""Counts of many variable sets in one job, for any number of columns.

A row's values stand in one array; each set is a list of places in it. A row is
exploded into (set id, its values), which combine map-side before the only
shuffle, so what is shuffled is cells, not rows. A set id is a plain number:
nothing is packed into the bits of a grouping id, so neither the number of
columns nor of sets is bounded by a word.

A row with a null in a set isn't counted for that set. An empty table or an
empty list of sets gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_sets(data: DataFrame, columns: list[str], sets: list[list[str]], weight: str | None = None) -> DataFrame:
    """(set_id, vals, n): the rows of each combination of values of ``sets[set_id]``,
    values in the set's own order; ``weight`` names a column of row counts."""
    place = {c: i for i, c in enumerate(columns)}
    wanted = F.from_json(F.lit(json.dumps([{"id": i, "at": [place[c] for c in s]} for i, s in enumerate(sets)])),
                         "array<struct<id: int, at: array<int>>>")
    rows = data.select(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]).alias("row"),
                       (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    cells = rows.select("row", "w", F.explode(wanted).alias("s")) \
                .select(F.col("s.id").alias("set_id"), "w",
                        F.transform("s.at", lambda i: F.get("row", i)).alias("vals")) \
                .filter(~F.exists("vals", lambda v: v.isNull()))
    return cells.groupBy("set_id", "vals").agg(F.sum("w").alias("n"))
