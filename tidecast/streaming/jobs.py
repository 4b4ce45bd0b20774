"""Streaming variants of the ingest and actuals steps. Each runs what is there and stops
(``availableNow``); progress lives in the checkpoint folder, results in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.ledger import actuals_by_slot

ALPHA = 0.3


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def dedup_txn(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of a transaction id within the watermark."""
    return stream.withWatermark("open_time", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def hourly(stream: DataFrame, delay: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and guests per entity and hour (or sliding window), in append mode. ``delay``
    None keeps the watermark the stream already has, as behind :func:`dedup_txn`."""
    win = F.window("open_time", "3 hours" if slide else "1 hour", slide)
    g = (stream.withWatermark("open_time", delay) if delay else stream).groupBy(win, "entity")
    return g.agg(F.count("*").alias("n"), F.sum("guests").alias("guests")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "entity", "n", "guests")


def sessions(stream: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Busy spells of an entity: transactions less than ``gap`` apart."""
    g = stream.withWatermark("open_time", delay).groupBy(F.session_window("open_time", gap), "entity")
    return g.agg(F.count("*").alias("n"), F.sum("guests").alias("guests")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "entity", "n", "guests")


def run_to_table(out: DataFrame, path: str, checkpoint: str) -> None:
    q = (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def _run_batches(stream: DataFrame, each, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def collect_actuals(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Partial sums per batch, written under the batch id: a repeated batch overwrites its own
    part, so every transaction counts once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        actuals_by_slot(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run_batches(stream, each, checkpoint)


def read_actuals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("entity", "date", "slot").agg(F.sum("real").alias("real"))


def fold_bias(daily: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Smoothed bias per entity over its days in order.

    daily: entity, date, error (one row per day, so an entity's array is bounded)."""
    arr = F.transform(F.sort_array(F.collect_list(F.struct("date", "error"))), lambda x: x["error"])
    g = daily.groupBy("entity").agg(arr.alias("e"), F.count("*").alias("days"))
    fold = F.aggregate("e", F.lit(0.0), lambda s, x: alpha * x + (1 - alpha) * s)
    return g.select("entity", fold.alias("bias"), "days")


def track_bias(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Sums and counts of the errors per entity and day, written under the batch id: a repeated
    batch overwrites its own part. A day may be spread over any number of batches, and rows that
    come late still count for their day. stream: entity, date, error."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sums = batch.where("error is not null").groupBy("entity", "date")
        sums = sums.agg(F.sum("error").alias("total"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run_batches(stream, each, checkpoint)


def newest_bias(spark: SparkSession, path: str, alpha: float = ALPHA) -> DataFrame:
    """The bias over all that has arrived: days are put together from their parts, then folded."""
    days = spark.read.parquet(path).groupBy("entity", "date").agg((F.sum("total") / F.sum("n")).alias("error"))
    return fold_bias(days, alpha)
