"""Case views derived from the driver tables.

``cases`` is one row per order shaped like the network's case table; ``docs`` is
``documents`` left-joined to ``labels``.  Each view has a DataFrame form (what
the library runs) and a SQL text (what the DuckDB oracle runs); both must give
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.sources.tables import read_table

# Fixed values of the view definition.
PRICE_UNUSUAL = 400000.0
DISCOUNT_DISSENT = 0.08


def per_order_lines(lines: DataFrame) -> DataFrame:
    """Per order: most frequent return flag (ties -> smallest), any line with
    status F, lines with a dissent-level discount, distinct flags.

    The flag domain is found first (one small distinct over one column); the
    aggregate is then plain conditional counts -- a code-generated hash
    aggregate, partial per task, one shuffle keyed by order.  (Object
    aggregates such as ``mode`` fall back to sort-based aggregation on many
    keys.)"""
    flags = sorted(r[0] for r in lines.select("l_returnflag").distinct()
                   .filter(F.col("l_returnflag").isNotNull()).collect())
    cnt = [F.sum((F.col("l_returnflag") == f).cast("int")).alias(f"_c{i}") for i, f in enumerate(flags)]
    agg = lines.groupBy("l_orderkey").agg(
        *cnt,
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("precedentAlteration"),
        F.sum((F.col("l_discount") >= DISCOUNT_DISSENT).cast("int")).alias("n_dissent"))
    # highest count first, then the smallest flag (larger -i)
    best = F.greatest(*[F.struct(F.col(f"_c{i}").alias("c"), F.lit(-i).alias("o"), F.lit(f).alias("f"))
                        for i, f in enumerate(flags)]) if flags else F.lit(None)
    n_flags = sum((F.col(f"_c{i}") > 0).cast("int") for i in range(len(flags))) if flags else F.lit(None)
    return agg.select("l_orderkey",
                      (best["f"] if flags else F.lit(None).cast("string")).alias("decisionType"),
                      "precedentAlteration", "n_dissent",
                      F.when(F.lit(True), n_flags).cast("int").alias("declarationUncon"))


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order.

    Plan shape: lineitem is aggregated per order once (partial aggregation
    map-side, one shuffle keyed by order; see ``per_order_lines``), orders
    join customer on its key (a
    shuffle join that scales with both), and nation/region are joined after
    being combined into a 25-row dimension whose size is fixed by the schema.
    """
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag",
                       "l_linestatus", "l_discount")
    per_order = per_order_lines(lines)
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                        "o_totalprice", "o_orderdate", "o_orderpriority")
    # codes, not prices and times, go through both shuffles
    orders = orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("lawType"),
                           F.year("o_orderdate").cast("int").alias("term"),
                           F.quarter("o_orderdate").cast("int").alias("lcDisposition"),
                           (F.col("o_totalprice") > PRICE_UNUSUAL).cast("int").alias("caseDispositionUnusual"),
                           F.substring("o_orderpriority", 1, 1).alias("_priority"))
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    geo = (read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
           .join(read_table(spark, sf_dir, "region", "r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    # left to itself Spark may broadcast the customers, whose file is small but who are many
    cust = customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    o = orders.join(cust.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        "term",
        F.col("r_name").alias("chief"),
        F.col("c_mktsegment").alias("issueArea"),
        "lawType",
        "caseDispositionUnusual",
        "lcDisposition",
        F.col("decisionType"),
        F.col("precedentAlteration").cast("int").alias("precedentAlteration"),
        F.coalesce(F.col("n_dissent"), F.lit(0)).cast("int").alias("minVotes"),
        F.col("declarationUncon"),
        F.col("_priority").cast("int").alias("caseDisposition"),
    )


RAW_CASES_SQL = f"""
cases_lines AS (
  SELECT l_orderkey,
         CAST(count(DISTINCT l_returnflag) AS INTEGER) AS declarationUncon,
         max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS precedentAlteration,
         sum(CASE WHEN l_discount >= {DISCOUNT_DISSENT} THEN 1 ELSE 0 END) AS n_dissent
  FROM lineitem GROUP BY l_orderkey),
cases_mode AS (
  SELECT l_orderkey, l_returnflag AS decisionType FROM (
    SELECT l_orderkey, l_returnflag,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS rk
    FROM lineitem GROUP BY l_orderkey, l_returnflag) WHERE rk = 1),
raw_cases AS (
  SELECT o.o_orderkey AS case_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS term,
         r.r_name AS chief,
         c.c_mktsegment AS issueArea,
         o.o_orderstatus AS lawType,
         CAST(o.o_totalprice > {PRICE_UNUSUAL} AS INTEGER) AS caseDispositionUnusual,
         CAST(quarter(o.o_orderdate) AS INTEGER) AS lcDisposition,
         m.decisionType,
         CAST(l.precedentAlteration AS INTEGER) AS precedentAlteration,
         CAST(coalesce(l.n_dissent, 0) AS INTEGER) AS minVotes,
         l.declarationUncon,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS caseDisposition
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN cases_lines l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN cases_mode m ON m.l_orderkey = o.o_orderkey)"""


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left-joined to ``labels``; length bucket = floor(log10(n_chars)) capped at 4."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return (docs.join(labels, "doc_id", "left")
            .select("doc_id", "lang", "source",
                    F.least(F.floor(F.log10(F.greatest(F.col("n_chars"), F.lit(1)))),
                            F.lit(4)).cast("int").alias("len_bucket"),
                    F.col("toxic").cast("int").alias("toxic"),
                    F.col("quality").cast("int").alias("quality")))


RAW_DOCS_SQL = """
raw_docs AS (
  SELECT d.doc_id, d.lang, d.source,
         CAST(least(floor(log10(greatest(d.n_chars, 1))), 4) AS INTEGER) AS len_bucket,
         CAST(l.toxic AS INTEGER) AS toxic, CAST(l.quality AS INTEGER) AS quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
