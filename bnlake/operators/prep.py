"""Data preparation (P1-P11) and data-quality aggregates (A1-A4).

Every function maps DataFrame(s) + spec to a DataFrame; none collects rows.
"""

from __future__ import annotations

import logging
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import binary_target, canonical, value_sort_keys
from bnlake.spec import DISPOSITION_LABELS, NetworkSpec

log = logging.getLogger(__name__)


# -- P1 ------------------------------------------------------------------
def derive_flag(df: DataFrame) -> DataFrame:
    """voteSplit: kept if present; else (coalesce(minVotes, 0) > 0); else copy of splitVote."""
    if "voteSplit" in df.columns:
        return df
    if "minVotes" in df.columns:
        return df.withColumn("voteSplit",
                             (F.coalesce(F.col("minVotes"), F.lit(0)) > 0).cast("int"))
    if "splitVote" in df.columns:
        log.warning("voteSplit falls back to splitVote, which may be constant")
        return df.withColumn("voteSplit", F.col("splitVote"))
    return df


# -- P2 ------------------------------------------------------------------
def validate_columns(df: DataFrame, spec: NetworkSpec) -> list[str]:
    """Required node columns that are absent (warned, not fatal)."""
    missing = sorted({n.column for n in spec.nodes} - set(df.columns))
    if missing:
        log.warning("missing required columns: %s", missing)
    return missing


def missing_columns_table(spark: SparkSession, df: DataFrame, spec: NetworkSpec) -> DataFrame:
    """P2 as data: required names anti-joined with present names."""
    required = spark.createDataFrame([(n.name, n.column, i) for i, n in enumerate(spec.nodes)],
                                     "variable string, column string, pos int")
    present = spark.createDataFrame([(c,) for c in df.columns], "column string")
    return required.join(present, "column", "left_anti").select("variable", "column", "pos")


# -- P3 / P4 / P5 ----------------------------------------------------------
def drop_missing_target(df: DataFrame, spec: NetworkSpec) -> DataFrame:
    col = spec.column(spec.target)
    return df.dropna(subset=[col]) if col in df.columns else df


def feature_columns(df: DataFrame, spec: NetworkSpec) -> list[str]:
    return [n.column for n in spec.nodes if n.name != spec.target and n.column in df.columns]


def drop_sparse_rows(df: DataFrame, spec: NetworkSpec, threshold: float = 0.5) -> DataFrame:
    """Keep rows whose null fraction over present feature columns is <= threshold."""
    cols = feature_columns(df, spec)
    if not cols:
        return df
    n_null = sum(F.col(c).isNull().cast("int") for c in cols)
    return df.filter(n_null / F.lit(float(len(cols))) <= F.lit(threshold))


def prepare_cases(df: DataFrame, spec: NetworkSpec, drop_target: bool = True,
                  threshold: float = 0.5) -> DataFrame:
    """P1 -> P2 -> P3 -> P4.  Idempotent."""
    df = derive_flag(df)
    validate_columns(df, spec)
    if drop_target:
        df = drop_missing_target(df, spec)
    return drop_sparse_rows(df, spec, threshold)


# -- P6 / P7 ----------------------------------------------------------------
def canonical_column(df: DataFrame, col: str):
    """``canonical`` of a column; whole numbers are such text as they are."""
    whole = df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(col).cast("string") if whole else canonical(F.col(col))


def node_columns(df: DataFrame, spec: NetworkSpec, names=None) -> list:
    names = spec.names if names is None else names
    return [canonical_column(df, spec.column(n)).alias(n) for n in names
            if spec.column(n) in df.columns]


def rename_nodes(df: DataFrame, spec: NetworkSpec, keep_key: bool = True) -> DataFrame:
    """Mapped columns renamed to node names (as strings); rows null in ANY mapped
    column dropped -- the fit's row filter, stricter than P4 (trap T1)."""
    spec = spec.restrict(df.columns)
    cols = ([F.col(spec.key)] if keep_key and spec.key in df.columns else []) + \
        node_columns(df, spec)
    # gaps are found in the columns as they are, so that no text is made twice
    whole = reduce(and_, [F.col(spec.column(n)).isNotNull() for n in spec.names], F.lit(True))
    return df.filter(whole).select(*cols)


def evidence_project(df: DataFrame, spec: NetworkSpec, track=None,
                     with_target: bool = True) -> DataFrame:
    """Key, evidence columns of a track (null = unobserved) and the target."""
    spec = spec.restrict(df.columns)
    ev = spec.track(track)
    cols = [F.col(spec.key)] + node_columns(df, spec, ev)
    if with_target:
        cols.append(canonical_column(df, spec.column(spec.target)).alias("y_true"))
    return df.select(*cols)


# -- P8 ---------------------------------------------------------------------
def evidence_filter(requests: DataFrame, allowed: list[str], ev_col: str = "evidence") -> DataFrame:
    """Requests carry ``map<string,string>`` evidence.  Keep allowed, non-null keys;
    report every key that isn't allowed, sorted, whether or not it has a value."""
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    m = F.col(ev_col)
    kept = F.map_filter(m, lambda k, v: F.array_contains(allowed_arr, k) & v.isNotNull())
    ignored = F.array_sort(F.array_except(F.map_keys(m), allowed_arr))
    return requests.withColumn("kept", kept).withColumn("ignored", ignored)


# -- P9 / P10 / P11 -----------------------------------------------------------
def binary_cases(df: DataFrame, spec: NetworkSpec) -> DataFrame:
    """Recode the target to affirm/reverse and drop rows in neither class."""
    col = spec.column(spec.target)
    return df.withColumn(col, binary_target(F.col(col))).filter(F.col(col).isNotNull())


def binary_collapse(post: DataFrame, key: str = "case_id") -> DataFrame:
    """Long posterior (key, class, p) -> binary posterior; zero mass -> 0.5/0.5."""
    b = post.withColumn("bclass", binary_target(F.col("class"))).filter(F.col("bclass").isNotNull())
    s = b.groupBy(key, "bclass").agg(F.sum("p").alias("pm"))
    w = Window.partitionBy(key)
    tot = F.sum("pm").over(w)
    full = s.select(key, F.col("bclass").cast("string").alias("class"),
                    F.when(tot > 0, F.col("pm") / tot).otherwise(F.lit(0.5)).alias("p"))
    # cases whose mass sits outside both classes still get 0.5 / 0.5
    keys = post.select(key).distinct()
    none = keys.join(full.select(key).distinct(), key, "left_anti")
    both = none.select(key, F.explode(F.array(F.lit("0"), F.lit("1"))).alias("class"),
                       F.lit(0.5).alias("p"))
    return full.unionByName(both)


def label_table(spark: SparkSession, labels: dict | None = None) -> DataFrame:
    labels = DISPOSITION_LABELS if labels is None else labels
    return spark.createDataFrame([(str(k), v) for k, v in labels.items()],
                                 "code string, label string")


def label_values(df: DataFrame, col: str, labels: DataFrame, out: str = "label") -> DataFrame:
    """Code -> label; unknown codes fall back to the code string.  The user's
    labels have no size bound, so the join strategy is left to Spark."""
    lab = labels.select(canonical(F.col("code")).alias("_code"), F.col("label").alias("_lab"))
    j = df.join(lab, canonical(F.col(col)) == F.col("_code"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lab"), canonical(F.col(col)))) \
            .drop("_code", "_lab")


# -- A1-A4 --------------------------------------------------------------------
def _long_values(df: DataFrame, spec: NetworkSpec) -> DataFrame:
    """(node, pos, value) for every present node column, nulls kept."""
    spec = spec.restrict(df.columns)
    pos = {n: i for i, n in enumerate(spec.names)}
    wide = df.select(*node_columns(df, spec))
    lng = wide.unpivot([], spec.names, "node", "value")
    mapping = F.create_map(*[x for n in spec.names for x in (F.lit(n), F.lit(pos[n]))])
    return lng.withColumn("pos", mapping[F.col("node")])


def missing_report(df: DataFrame, spec: NetworkSpec) -> DataFrame:
    """n_missing and pct (2 dp) per variable, topological order -- one pass."""
    spec = spec.restrict(df.columns)
    aggs = [F.sum(F.col(n.column).isNull().cast("long")).alias(n.name) for n in spec.nodes]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    lng = wide.unpivot(["_n"], spec.names, "variable", "n_missing")
    cols = F.create_map(*[x for n in spec.nodes for x in (F.lit(n.name), F.lit(n.column))])
    pos = F.create_map(*[x for i, n in enumerate(spec.nodes) for x in (F.lit(n.name), F.lit(i))])
    return lng.select(
        pos[F.col("variable")].alias("pos"), "variable",
        cols[F.col("variable")].alias("column"),
        F.col("n_missing").cast("long").alias("n_missing"),
        F.round(F.col("n_missing") / F.col("_n") * 100.0, 2).alias("pct_missing"))


def rare_categories(df: DataFrame, spec: NetworkSpec, min_count: int = 5) -> DataFrame:
    """(variable, value, count) with count < min_count, nulls excluded."""
    lng = _long_values(df, spec).filter(F.col("value").isNotNull())
    c = lng.groupBy("pos", "node", "value").agg(F.count(F.lit(1)).alias("count"))
    return c.filter(F.col("count") < min_count).withColumnRenamed("node", "variable")


def target_distribution(df: DataFrame, spec: NetworkSpec, labels: DataFrame) -> DataFrame:
    """Count and percentage per target code, labelled.  The total comes from a
    window over the (few) grouped rows, null group included, then dropped."""
    col = spec.column(spec.target)
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    c = c.withColumn("_n", F.sum("count").over(Window.partitionBy()))
    c = c.filter(F.col(col).isNotNull()).select(
        F.col(col).cast("string").alias("code"), "count",
        F.round(F.col("count") / F.col("_n") * 100.0, 2).alias("pct"))
    return label_values(c, "code", labels)


def value_domains(nodes: DataFrame, spec: NetworkSpec) -> DataFrame:
    """(node, value, ord): distinct observed values per node in domain order
    (numbers first by numeric value, then strings)."""
    spec = spec.restrict(nodes.columns, by_name=True)
    lng = nodes.select(*spec.names).unpivot([], spec.names, "node", "value")
    d = lng.filter(F.col("value").isNotNull()).distinct()
    w = Window.partitionBy("node").orderBy(*value_sort_keys(F.col("value")))
    return d.withColumn("ord", F.row_number().over(w).cast("int"))
