"""Structured Streaming forms of the append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.operators.lifecycle import decide, lifecycle_state
from tessella.sources.files import scratch


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Parquet files arriving in the folder ``path`` as a stream, optionally only names matching ``glob``."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def drain(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run an append-mode stream over what has arrived and read its output back."""
    spark = stream.sparkSession
    out = path or scratch(spark)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], order: list[str], path: str | None = None) -> DataFrame:
    """Run an update-mode stream and read the newest row of every key.

    Each micro-batch writes its changed keys to a folder of its own, overwritten when the batch is
    repeated, so a restart neither loses nor doubles a change.
    """
    spark = stream.sparkSession
    out = path or scratch(spark)

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "batch")).alias("x")).select(*keys, "x.*")


def attempt_windows(attempts: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts, failures and mean latency per service; a window is final once the watermark passed it.

    ``attempts``: (created_at, service, status, latency_ms). Works on a stream and on a table alike.
    """
    a = attempts.withWatermark("created_at", delay) if attempts.isStreaming else attempts
    return a.groupBy(F.window("created_at", width).alias("w"), "service").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), F.avg("latency_ms").alias("avg_latency")).select(
        F.col("w.start").alias("window_start"), "service", "attempts", "failures", "avg_latency")


def current_stages(events: DataFrame) -> DataFrame:
    """Latest stage and status per (run, document)."""
    return events.groupBy("run_id", "document_id").agg(
        F.max("created_at").alias("at"), F.max_by(F.struct("stage", "status"), F.struct("created_at", "event_id")).alias("x")).select(
        "run_id", "document_id", "at", "x.stage", "x.status")


def stalled_stages(events: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Starts without an end of the same stage within the timeout, reported once the watermark has passed it."""
    starts = events.filter("status = 'started'").select(
        F.col("event_id"), F.col("run_id").alias("s_run"), F.col("document_id").alias("s_doc"), F.col("stage").alias("s_stage"), F.col("created_at").alias("started_at"))
    ends = events.filter("status <> 'started'").select("run_id", "document_id", "stage", F.col("created_at").alias("ended_at"))
    if events.isStreaming:
        starts, ends = starts.withWatermark("started_at", delay), ends.withWatermark("ended_at", delay)
    on = (
        (F.col("s_run") == F.col("run_id")) & (F.col("s_doc") == F.col("document_id")) & (F.col("s_stage") == F.col("stage"))
        & (F.col("ended_at") > F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {timeout}")))
    return starts.join(ends, on, "left_outer").filter("ended_at IS NULL").select(
        "event_id", F.col("s_run").alias("run_id"), F.col("s_doc").alias("document_id"), F.col("s_stage").alias("stage"), "started_at")


def first_submissions(submissions: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Drop repeats of a submission key that arrive within the watermark delay."""
    return submissions.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def ingest_stream(documents: DataFrame, links: DataFrame, selections: DataFrame, complete: DataFrame, path: str | None = None) -> DataFrame:
    """Classify documents of each micro-batch against the active snapshots; one folder of decisions per batch.

    ``documents``: stream of (domain, document_id, content_hash).
    """
    spark = documents.sparkSession
    out = path or scratch(spark)

    def write(df: DataFrame, batch_id: int) -> None:
        decide(lifecycle_state(df, links, selections, complete)).select("domain", "document_id", "content_hash", "action").write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    q = documents.writeStream.foreachBatch(write).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user's queries; late rows are dropped, a session is final once the watermark passed its end."""
    e = events.withWatermark("created_at", delay) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("queries")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "queries")


def sliding_activity(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Queries per user type in overlapping windows."""
    e = events.withWatermark("created_at", delay) if events.isStreaming else events
    return e.groupBy(F.window("created_at", width, slide).alias("w"), "event_type").agg(F.count("*").alias("queries")).select(
        F.col("w.start").alias("window_start"), "event_type", "queries")
