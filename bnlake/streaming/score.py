"""Structured Streaming operators (ST1-ST3).

* ``stream_score``: a stream of evidence rows, each micro-batch scored by the
  batch operator (any null pattern, any value).
* ``stream_counts``: CPT counts are additive, so each micro-batch's grouping-set
  counts are appended (idempotently, per batch id) and summed on read.
* ``stream_windowed_logloss``: per-row log-loss against a fixed model,
  aggregated in tumbling event-time windows with a watermark (window state
  older than the watermark is evicted; Spark keeps every row within the
  watermark and does not promise to drop each later one); update mode through
  ``foreachBatch``, last update per window wins.

Sources are file streams; runs use ``trigger(availableNow=True)`` so a test
processes what is there and stops.  Checkpoints live under the session's
shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bnlake.functions.scalar import clip_log
from bnlake.operators import cpt as cptops
from bnlake.operators.posterior import posterior_exact
from bnlake.sources.model_store import scratch_path


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_score(spark: SparkSession, source: str, schema, spec, factors: dict, doms,
                 ev_vars: list[str], key: str, sink: str | None = None, max_files: int | None = None) -> DataFrame:
    """Exact posterior of every streamed evidence row: each micro-batch goes
    through the batch operator, so rows with unobserved or unknown values are
    answered like all others.  Returns the sink read back as a batch DataFrame."""
    sink = sink or scratch_path(spark, "stream-score")

    def per_batch(batch: DataFrame, batch_id: int):
        out = posterior_exact(batch.sparkSession, spec, factors, doms, batch, ev_vars, key=key)
        # overwrite this batch's folder: a retried batch replaces, never doubles
        out.write.mode("overwrite").parquet(f"{sink}/data/batch_id={batch_id}")

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    q = (reader.parquet(source).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start())
    _run(q)
    kind = schema[key].dataType.simpleString()
    return spark.read.schema(f"{key} {kind}, class string, class_ord int, p double").parquet(f"{sink}/data") \
        .select(key, "class", "class_ord", "p")


def stream_counts(spark: SparkSession, source: str, schema, spec, sink: str | None = None,
                  max_files: int = 1) -> DataFrame:
    """Grouping-set counts per micro-batch, appended per batch id, summed on read."""
    sink = sink or scratch_path(spark, "stream-counts")

    def per_batch(batch: DataFrame, batch_id: int):
        c = cptops.cpt_counts(batch, spec)
        # overwrite this batch's folder: a retried batch replaces, never doubles
        c.write.mode("overwrite").parquet(f"{sink}/data/batch_id={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start())
    _run(q)
    pas = [f"pa{i}" for i in range(1, spec.max_parents + 1)]
    return spark.read.parquet(f"{sink}/data").groupBy("node", "depth", *pas, "value") \
        .agg(F.sum("n").cast("long").alias("n"))


def marginal_model(events: DataFrame, label_col: str, until) -> DataFrame:
    """Fixed model for the drift monitor: the label distribution before ``until``."""
    c = events.filter(F.col("ts") < F.lit(until)).groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    return c.select(label_col, (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("p"))


def stream_windowed_logloss(spark: SparkSession, source: str, schema, model: DataFrame,
                            label_col: str, window: str = "1 hour", watermark: str = "1 hour",
                            sink: str | None = None, max_files: int | None = None) -> DataFrame:
    """(window_start, window_end, n, log_loss) per event-time window."""
    sink = sink or scratch_path(spark, "stream-logloss")
    # watermarks need an instant type: NTZ event times are read as instants in
    # the session time zone, and window bounds are turned back into NTZ below
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source) \
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    # one model row per label value; whether that is small is Spark's to measure
    scored = stream.join(model, label_col, "left") \
                   .withColumn("ll", -clip_log(F.coalesce(F.col("p"), F.lit(0.0))))
    agg = scored.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ll").alias("log_loss"))

    def per_batch(batch: DataFrame, batch_id: int):
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     "n", "log_loss", F.lit(batch_id).alias("batch_id")) \
             .write.mode("overwrite").parquet(f"{sink}/data/batch={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start())
    _run(q)
    out = spark.read.parquet(f"{sink}/data")
    last = Window.partitionBy("window_start").orderBy(F.col("batch_id").desc())
    return out.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") == 1) \
              .select("window_start", "window_end", F.col("n").cast("long").alias("n"), "log_loss")


def batch_windowed_logloss(events: DataFrame, model: DataFrame, label_col: str,
                           window: str = "1 hour") -> DataFrame:
    """Batch twin of ``stream_windowed_logloss`` (equality check)."""
    scored = events.join(model, label_col, "left") \
                   .withColumn("ll", -clip_log(F.coalesce(F.col("p"), F.lit(0.0))))
    return scored.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ll").alias("log_loss")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "log_loss")
