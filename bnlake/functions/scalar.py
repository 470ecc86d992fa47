"""Scalar column helpers.  All are built-in expressions, so they stay inside
whole-stage codegen; each has a SQL twin used by the DuckDB oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from bnlake.spec import BINARY_AFFIRM, BINARY_REVERSE, LOG_CLIP

TWO_52 = float(2 ** 52)


def clip_log(p: Column, eps: float = LOG_CLIP) -> Column:
    """ln(clip(p, eps, 1))."""
    return F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(eps)))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def seeded_uniform(*parts) -> Column:
    """Order-free, partition-independent uniform draw in [0, 1).

    u = first 52 bits of md5(parts joined by '|') / 2^52.  Keyed by stable ids
    only (seed, replicate, draw, case id), so a recomputed task after an
    executor loss draws the same numbers.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 13)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def sql_uniform(*parts: str) -> str:
    """SQL twin of ``seeded_uniform``; parts are SQL expressions."""
    inner = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({inner}), 1, 13)) AS BIGINT) / {TWO_52!r})"


def canonical(value: Column) -> Column:
    """Text of a code, the same for 1, 1.0 and "1.0".  Only text with ".0" in it can
    change; the pattern is slow, so other text doesn't meet it."""
    text = value.cast("string")
    return F.when(text.contains(".0"), F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")).otherwise(text)


def binary_target(code: Column) -> Column:
    """Affirm {2} -> 0, reverse {3,4,5,8} -> 1, anything else (or unparseable) -> null."""
    c = code.cast("string").try_cast("double").try_cast("int")
    return (F.when(c.isin(*BINARY_AFFIRM), F.lit(0))
            .when(c.isin(*BINARY_REVERSE), F.lit(1)))


def sql_binary_target(expr: str) -> str:
    c = f"TRY_CAST(TRY_CAST(CAST({expr} AS VARCHAR) AS DOUBLE) AS INTEGER)"
    aff = ", ".join(map(str, BINARY_AFFIRM))
    rev = ", ".join(map(str, BINARY_REVERSE))
    return f"(CASE WHEN {c} IN ({aff}) THEN 0 WHEN {c} IN ({rev}) THEN 1 END)"


def value_sort_keys(value: Column) -> list[Column]:
    """Numbers first by numeric value, then strings -- the domain order."""
    num = value.try_cast("double")
    return [num.asc_nulls_last(), value.asc()]


def chi2_sf_even(g: Column, dof: Column) -> Column:
    """Chi-square survival function for even dof, as a finite sum in log space:
    sf = sum_{i<dof/2} exp(i*ln(g/2) - g/2 - ln i!).  Null for odd dof."""
    half = g / 2.0
    terms = F.aggregate(
        F.sequence(F.lit(0), (dof / 2).cast("int") - 1),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lf")),
        lambda acc, i: F.struct(
            (acc["s"] + F.exp(i * F.log(F.greatest(half, F.lit(1e-300))) - half
                              - (acc["lf"] + F.when(i > 0, F.log(i.cast("double")))
                                 .otherwise(F.lit(0.0))))).alias("s"),
            (acc["lf"] + F.when(i > 0, F.log(i.cast("double"))).otherwise(F.lit(0.0))).alias("lf")),
        lambda acc: acc["s"])
    return (F.when(dof <= 0, F.lit(1.0))
            .when(dof % 2 == 0, F.when(g <= 0, F.lit(1.0)).otherwise(F.least(terms, F.lit(1.0)))))


def chi2_sf_py(g: float, dof: int) -> float:
    """Exact chi-square survival for integer dof (even: finite sum; odd: erfc term)."""
    if dof <= 0 or g <= 0:
        return 1.0
    x = g / 2.0
    if dof % 2 == 0:
        s, lf = 0.0, 0.0
        for i in range(dof // 2):
            if i:
                lf += math.log(i)
            s += math.exp(i * math.log(x) - x - lf)
        return min(1.0, s)
    s = math.erfc(math.sqrt(x))
    # odd dof: add sum_{i<(dof-1)/2} x^(i+1/2) e^-x / Gamma(i+3/2)
    for i in range((dof - 1) // 2):
        s += math.exp((i + 0.5) * math.log(x) - x - math.lgamma(i + 1.5))
    return min(1.0, s)


def chi2_sf(g: Column, dof: Column) -> Column:
    """Chi-square survival for any whole dof: the upper incomplete gamma ratio
    Q(dof/2, g/2), by its power series below dof/2 + 1 and by its continued
    fraction from there on.  Null g or dof gives null; dof or g <= 0 gives 1."""
    x, a = g / 2.0, dof / 2.0
    odd = dof % 2 == 1
    start = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    steps = F.floor((dof - 1) / 2).cast("int")
    log_gamma = F.aggregate(F.sequence(F.lit(0), steps), F.when(odd, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0)),
                            lambda t, i: t + F.when(i < steps, F.log(start + i)).otherwise(F.lit(0.0)))
    front = a * F.log(x) - x - log_gamma
    n = (F.lit(60) + 12 * F.sqrt(a)).cast("int")
    series = F.aggregate(F.sequence(F.lit(1), n), F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")),
                         lambda acc, i: F.struct((acc["t"] * x / (a + i)).alias("t"),
                                                 (acc["s"] + acc["t"] * x / (a + i)).alias("s")), lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), x + 2.0 * n + 1.0 - a,
                           lambda t, i: x + 2.0 * i - 1.0 - a - i * (i - a) / t)
    q = F.when(x < a + 1, 1.0 - F.exp(front) * series).otherwise(F.exp(front) / fraction)
    return (F.when(g.isNull() | dof.isNull(), F.lit(None).cast("double"))
            .when((dof <= 0) | (g <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(q, F.lit(1.0)))))


def round_doubles(df, digits: int = 6):
    """Round every double column (presentation / oracle comparison)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])
