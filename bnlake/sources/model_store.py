"""Sources and sinks (S1-S5): case CSV scan, release discovery, model store.

A stored model is a folder: ``cpt/`` (Parquet, partitioned by node),
``domains/`` (Parquet) and ``meta/`` (one JSON row: hyper-parameters, parents,
split spec).  Value order is never taken from file order: it is recomputed
from the values on load.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bnlake.functions.scalar import value_sort_keys
from bnlake.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

# Case table schema of the source CSV (all nullable).
CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()), T.StructField("term", T.IntegerType()),
    T.StructField("chief", T.StringType()), T.StructField("issueArea", T.StringType()),
    T.StructField("lawType", T.StringType()), T.StructField("caseDispositionUnusual", T.IntegerType()),
    T.StructField("lcDisposition", T.IntegerType()), T.StructField("decisionType", T.StringType()),
    T.StructField("precedentAlteration", T.IntegerType()), T.StructField("minVotes", T.IntegerType()),
    T.StructField("declarationUncon", T.IntegerType()), T.StructField("caseDisposition", T.IntegerType()),
])

RELEASE_GLOB = "SCDB_*caseCentered*.csv"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/bnlake-{name}-{uuid.uuid4().hex[:12]}"


# -- S1 -------------------------------------------------------------------
def write_cases_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(path)


def scan_cases_csv(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """Header CSV in latin-1, columns taken by name (in any order, among others)
    and read as the schema's types; a value that doesn't parse is null, and a
    column that the file lacks is left out, so that its node drops from the model."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").csv(path))
    present = {c.lower(): c for c in raw.columns}
    def typed(f):
        c = F.col(f"`{present[f.name.lower()]}`")
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            c = c.try_cast("double").try_cast(f.dataType)      # "3" and "3.0" are both 3
        return c.alias(f.name)
    missing = [f.name for f in schema if f.name.lower() not in present]
    if missing:
        log.warning("columns not in %s: %s", path, missing)
    return raw.select(*[typed(f) for f in schema if f.name.lower() in present])


# -- S2 -------------------------------------------------------------------
def pick_release(spark: SparkSession, folder: str, pattern: str = RELEASE_GLOB) -> str:
    """Newest release = lexicographic max of matching file names (a listing,
    no data read).  None found -> FileNotFoundError with a hint."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/" + pattern)
    stats = p.getFileSystem(conf).globStatus(p)
    names = sorted(str(s.getPath().toString()) for s in (stats or []))
    if not names:
        raise FileNotFoundError(f"no {pattern} under {folder}; fetch a case-centered release first")
    return names[-1]


# -- S3 / S4 ------------------------------------------------------------------
def write_model(cpt: DataFrame, domains: DataFrame, meta: dict, path: str) -> None:
    cpt.write.mode("overwrite").partitionBy("node").parquet(f"{path}/cpt")
    domains.select("node", "value").write.mode("overwrite").parquet(f"{path}/domains")
    spark = cpt.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_model(spark: SparkSession, path: str, max_parents: int) -> tuple[DataFrame, DataFrame, dict]:
    pas = ", ".join(f"pa{i} string" for i in range(1, max_parents + 1))
    schema = f"depth int, {pas}, value string, ord int, n long, n_pa long, p double, node string"
    cpt = spark.read.schema(schema).parquet(f"{path}/cpt")
    dom = spark.read.schema("node string, value string").parquet(f"{path}/domains")
    dom = dom.withColumn("ord", F.row_number().over(
        Window.partitionBy("node").orderBy(*value_sort_keys(F.col("value")))).cast("int"))
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    # re-derive each row's value order from the reloaded domains
    cpt = cpt.drop("ord").join(dom, ["node", "value"])
    cols = ["node", "depth"] + [f"pa{i}" for i in range(1, max_parents + 1)] + \
        ["value", "ord", "n", "n_pa", "p"]
    return cpt.select(*cols), dom, meta


# -- S5 ---------------------------------------------------------------------
def schema_report(domains: DataFrame, spec, track_all: str = "explanatory",
                  track_ex_ante: str = "ex_ante", descriptions: dict | None = None,
                  labels: DataFrame | None = None) -> DataFrame:
    """Per explanatory field and value: description, ex-ante flag, label
    (fallback: the code itself), in domain order -- one row per value."""
    spark = domains.sparkSession
    fields = spec.track(track_all)
    ex = set(spec.track(track_ex_ante))
    descriptions = descriptions or {}
    meta = spark.createDataFrame([(f, descriptions.get(f, ""), f in ex) for f in fields],
                                 "node string, description string, ex_ante boolean")
    d = domains.join(F.broadcast(meta), "node")        # one row per field: fixed by the spec
    if labels is not None:
        lab = labels.select(F.col("node").alias("_n"), F.col("code").alias("_c"), F.col("label").alias("_l"))
        d = d.join(lab, (d["node"] == lab["_n"]) & (d["value"] == lab["_c"]), "left") \
             .withColumn("label", F.coalesce("_l", "value")).drop("_n", "_c", "_l")
    else:
        d = d.withColumn("label", F.col("value"))
    return d.select(F.col("node").alias("field"), "description", "ex_ante", "value", "ord", "label")
