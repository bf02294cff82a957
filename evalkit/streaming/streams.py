"""Streaming operators. Each takes a (streaming or batch) DataFrame, so that streams can be held against batch results."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def model_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """One row per key among those that arrive within the delay; state older than the watermark is dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def sliding_rate(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and rate per sliding window of event time; times are zoneless again."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.unix_micros("b") - F.unix_micros("a")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", F.round(F.when((F.col("n") >= 2) & (span > 0), (F.col("n") - 1) * 1e6 / span), 6).alias("rate"))


_STATE = "job_id string, status string, changes long, last timestamp"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A job's status after its events, in the order of their times; a finished job stays finished."""
    status, changes, last = state.get if state.exists else ("pending", 0, 0)
    for pdf in batches:
        for event, ts in pdf.sort_values("ts")[["event", "ts"]].itertuples(index=False):
            micros = int(ts.value // 1000)
            new = {"claim": "in_progress", "complete": "done", "fail": "failed", "reset": "pending"}.get(event)
            if new and micros >= last and not (status in ("done", "failed") and event != "reset"):
                changes += new != status
                status, last = new, micros
    state.update((status, changes, last))
    yield pd.DataFrame([(key[0], status, changes, pd.Timestamp(last, unit="us"))], columns=["job_id", "status", "changes", "last"])


def job_states(events: DataFrame) -> DataFrame:
    """The state machine of jobs, over a stream of (job_id, event, ts): updates as they happen."""
    return events.groupBy("job_id").applyInPandasWithState(_fold, _STATE, "status string, changes long, last long", "update", "NoTimeout")


def finish(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Runs a stream over all there is and returns its rows, from a table in memory. For tests and small reports."""
    spark, folder = stream.sparkSession, tempfile.mkdtemp(prefix="evalkit-stream-")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        query = query.option("checkpointLocation", folder)
    try:
        query.start().awaitTermination()
        return spark.table(name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> None:
    """Appends a stream's rows to files exactly once; a restart goes on from the checkpoint."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch and its number to ``act``, which must be idempotent."""
    stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
