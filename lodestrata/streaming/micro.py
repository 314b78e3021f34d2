"""Structured Streaming over files of readings: windows, duplicates, upserts, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import silver
from lodestrata.sources import writers

LATE = "10 minutes"
STATES = ["HEALTHY", "DEGRADING", "WARNING", "CRITICAL", "FAILED", "MAINTAINED"]


def file_source(spark: SparkSession, root: str, schema: T.StructType, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(root)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = LATE) -> DataFrame:
    """Counts and sums per window and key; the same rule for batches and streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str) -> DataFrame:
    out = events.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n", "total")


def deduplicated(events: DataFrame, ts: str, key: str, late: str = LATE) -> DataFrame:
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_sink(stream: DataFrame, merge, checkpoint: str):
    """Runs ``merge(batch, epoch)`` on all that is there, then stops."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_upsert(root: str, key: str, content_hash: str, newest: str):
    """A ``merge`` for ``upsert_sink``: of each key the newest row of a batch is inserted, updated or
    skipped.  Every epoch leaves a whole version of the table in a folder of its own, so that
    a replay writes the same version again and readers never see half of one."""

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = silver.latest(batch, [key], [F.desc(newest), F.desc(content_hash)])
        if epoch:
            rows = writers.upsert(batch.sparkSession.read.parquet(f"{root}/{epoch - 1:09d}"), rows, key, content_hash).drop("action")
        rows.write.mode("overwrite").parquet(f"{root}/{epoch:09d}")

    return merge


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
