"""Train/test splits and fold assignment (P12-P14) without a global sort.

An exact count cut ("the first c rows in key order") would normally need
``row_number()`` over the whole table, i.e. one task.  Instead
``key_at_rank`` finds the key of the row at a given rank with a few small
histogram aggregates: bucket the leading key, find the bucket holding the
rank, narrow to it, and move to the next key when a bucket holds a single
value (a hot term holding a third of the rows is handled the same way).  Only
once a bucket is small is a window used, on that bucket alone.  Then a split
is a plain filter ``key <= threshold``.
"""

from __future__ import annotations

import logging

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import seeded_uniform
from bnlake.spec import DEFAULT_SEED, DEFAULT_TEST_FRACTION

log = logging.getLogger(__name__)

N_BUCKETS = 1024
SMALL = 100_000


def _lex_le(keys: list[str], values: tuple) -> Column:
    """(k1, k2, ...) <= (v1, v2, ...) lexicographically."""
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        here = F.col(keys[i]) < F.lit(values[i]) if i < len(keys) - 1 else \
            F.col(keys[i]) <= F.lit(values[i])
        cond = here if cond is None else here | ((F.col(keys[i]) == F.lit(values[i])) & cond)
    return cond


def key_stats(df: DataFrame, key: str) -> tuple:
    """(min, max, count) of the leading key in one pass."""
    r = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return r["lo"], r["hi"], r["n"]


def key_at_rank(df: DataFrame, keys: list[str], rank: int, stats: tuple | None = None) -> tuple | None:
    """Key tuple of the row with 1-based ``rank`` in ascending key order.
    Keys are numbers or text (in byte order), non-null, and unique together.  ``stats`` = a known
    (min, max, count) of the leading key saves the first pass."""
    if rank <= 0:
        return None
    fixed: list = []
    cur = df.select(*keys)
    level = 0
    lo = hi = None
    if stats is not None:
        lo, hi, n = stats
        if n == 0 or rank > n:
            return None
    while True:
        k = keys[level]
        if lo is None:
            r = cur.agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count(F.lit(1)).alias("n")).first()
            lo, hi, n = r["lo"], r["hi"], r["n"]
            if n == 0 or rank > n:
                return None
        if n <= SMALL or level == len(keys) - 1 and lo == hi:
            w = Window.orderBy(*keys[level:])          # bounded: n <= SMALL rows
            row = cur.withColumn("_rn", F.row_number().over(w)) \
                     .filter(F.col("_rn") == rank).first()
            return tuple(fixed) + tuple(row[x] for x in keys[level:])
        if lo == hi:
            fixed.append(lo)
            cur = cur.filter(F.col(k) == F.lit(lo))
            level += 1
            lo = None
            continue
        if isinstance(lo, str):
            # text: the two bytes after what smallest and largest share tell buckets apart, in byte order
            b = F.hex(F.substring(F.col(k).cast("binary"), _shared_bytes(lo, hi) + 1, 2))
        else:
            width = (float(hi) - float(lo)) / N_BUCKETS
            b = F.least(F.floor((F.col(k) - F.lit(lo)) / F.lit(width)), F.lit(N_BUCKETS - 1)).cast("int")
        hist = (cur.withColumn("_b", b).groupBy("_b")
                .agg(F.count(F.lit(1)).alias("c"), F.min(k).alias("mn"), F.max(k).alias("mx"))
                .orderBy("_b").collect())               # <= N_BUCKETS rows, for text <= 65,793
        acc = 0
        for h in hist:
            if acc + h["c"] >= rank:
                rank -= acc
                cur = cur.filter((F.col(k) >= F.lit(h["mn"])) & (F.col(k) <= F.lit(h["mx"])))
                lo, hi, n = h["mn"], h["mx"], h["c"]
                break
            acc += h["c"]


def _shared_bytes(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def number_of(df: DataFrame, col: str):
    """A column as a long that keeps its order: dates by day, instants by
    microsecond, numbers as they are. Text has no numeric order: its hash, which
    is stable and tells keys apart."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(col)
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "string":
        return F.xxhash64(c)
    return c.cast("long")


def text_kind(df: DataFrame, col: str, date_format: str | None = None) -> str:
    """What a whole text column holds: "long", "double" or "date" if every value
    present reads as one, else "text".  With ``date_format`` every value must be such a date."""
    c = F.trim(F.col(col))
    day = F.try_to_timestamp(c, F.lit(date_format)) if date_format else \
        F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), c.try_cast("date"))
    r = df.agg(F.count(col).alias("n"), F.count_if(c.rlike(r"^[+-]?\d{1,18}$")).alias("long"),
               F.count(c.try_cast("double")).alias("double"), F.count(day).alias("date")).first()
    if date_format:
        if r["date"] < r["n"]:
            raise ValueError(f"{r['n'] - r['date']} values of {col} aren't dates of the form {date_format}")
        return "date"
    for kind in ("long", "double", "date"):
        if r[kind] == r["n"]:
            return kind
    if r["double"] or r["date"]:
        log.warning("%s holds numbers or dates among other text; ordered as text", col)
    return "text"


def _sortable(df: DataFrame, col: str, date_format: str | None = None) -> Column:
    """A column as numbers or text in its own order, without loss."""
    c, kind = F.col(col), df.schema[col].dataType.typeName()
    if kind == "string":
        text = text_kind(df, col, date_format)
        if text == "date":
            d = F.try_to_timestamp(F.trim(c), F.lit(date_format)) if date_format else F.trim(c).cast("date")
            return F.unix_micros(d.cast("timestamp"))
        return c if text == "text" else F.trim(c).cast(text)
    return c.cast("double") if kind in ("double", "float", "decimal") else number_of(df, col)


def _order_keys(df: DataFrame, order_col: str, key: str, date_format: str | None = None) -> tuple[DataFrame, list[str]]:
    """Order columns: the value (one kind for the whole column, nulls last), then the key."""
    first = _sortable(df, order_col, date_format)
    out = df.withColumn("_k1", first)
    rest = df.schema[key].dataType.typeName() == "string"
    out = out.withColumn("_k2", F.col(key) if rest else number_of(df, key))
    if out.schema["_k1"].dataType.typeName() == "string":
        return out.withColumn("_k0", F.col("_k1").isNull().cast("int")) \
                  .withColumn("_k1", F.coalesce("_k1", F.lit(""))), ["_k0", "_k1", "_k2"]
    return out.withColumn("_k1", F.coalesce("_k1", F.lit(2 ** 62))), ["_k1", "_k2"]


def chrono_column(df: DataFrame, wanted: str = "term", fallback: str = "dateDecision",
                  key: str = "case_id") -> str:
    """Column that orders the cases: the term, else the decision date, else the key."""
    for c in (wanted, fallback):
        if c in df.columns:
            return c
        log.warning("no column %s to split by time", c)
    return key


def split_chrono(df: DataFrame, order_col: str = "term", key: str = "case_id",
                 test_fraction: float = DEFAULT_TEST_FRACTION, date_format: str | None = None) -> DataFrame:
    """Adds ``is_train``: first int(n * (1 - f)) rows by (order_col, key);
    without that column by dateDecision, and without that by the key.  A text
    column is ordered as numbers, dates or text, decided once for all its values
    (``date_format`` says that it holds dates of that form); nulls come last."""
    order_col = chrono_column(df, order_col, key=key)
    kd, keys = _order_keys(df, order_col, key, date_format)
    stats = key_stats(kd, keys[0])
    cut = int(stats[2] * (1 - test_fraction))
    t = key_at_rank(kd, keys, cut, stats)
    flag = _lex_le(keys, t) if t is not None else F.lit(False)
    return kd.withColumn("is_train", flag).drop(*keys)


def _random_keys(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_k1", seeded_uniform(F.lit(seed), F.col(key))) \
             .withColumn("_k2", number_of(df, key)), ["_k1", "_k2"]


def split_random(df: DataFrame, key: str = "case_id", test_fraction: float = DEFAULT_TEST_FRACTION,
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """Seeded permutation by md5(seed|key), exact count cut."""
    kd, keys = _random_keys(df, key, seed)
    stats = key_stats(kd, keys[0])
    cut = int(stats[2] * (1 - test_fraction))
    t = key_at_rank(kd, keys, cut, stats)
    flag = _lex_le(keys, t) if t is not None else F.lit(False)
    return kd.withColumn("is_train", flag).drop(*keys)


def kfold_assign(df: DataFrame, k: int = 5, key: str = "case_id",
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """fold = least(floor((rank-1) / (n div k)), k-1) on the seeded
    permutation; the last fold takes the remainder."""
    kd, keys = _random_keys(df, key, seed)
    stats = key_stats(kd, keys[0])
    size = stats[2] // k
    if size == 0:
        return kd.withColumn("fold", F.lit(k - 1)).drop(*keys)
    ts = [key_at_rank(kd, keys, j * size, stats) for j in range(1, k)]
    fold = reduce(lambda a, b: a + b,
                  [F.when(_lex_le(keys, t), F.lit(0)).otherwise(F.lit(1)) for t in ts if t],
                  F.lit(0))
    return kd.withColumn("fold", fold.cast("int")).drop(*keys)
