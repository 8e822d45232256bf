"""Stream jobs over landed event and bar files.

Watermarks bound the state; ``foreachBatch`` sinks are idempotent because a bar is
replaced by its key and published partitions are overwritten whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.clock import UTC_OFFSET_HOURS
from tickloom.functions.text import contains_any
from tickloom.operators.context import DISCLOSURE_BASE, DISCLOSURE_RAISE, DISCLOSURE_WORDS
from tickloom.operators.skew import first_per_key
from tickloom.sources.sinks import merge_bars

EVENT_KEY = ["Date", "Symbol", "source_type", "title", "raw_id"]


def dedupe_stream(events: DataFrame, time: str = "published_at", late: str = "2 days") -> DataFrame:
    """Drop repeated events whose copies arrive within the late-data bound."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(EVENT_KEY)


def daily_counts_stream(events: DataFrame, time: str = "signal_at", late: str = "1 day") -> DataFrame:
    """Events and disclosure score per symbol, source and local trading day.

    Day windows start at 15:00 UTC, local midnight. In append mode a window is emitted once
    the watermark has passed its end, in update mode whenever it has changed.
    """
    raised = F.when((F.col("source_type") == "disclosure") & contains_any(F.col("title"), DISCLOSURE_WORDS), 1).otherwise(0)
    filed = F.when(F.col("source_type") == "disclosure", 1).otherwise(0)
    day = F.window(time, "1 day", startTime="15 hours")
    grouped = events.withWatermark(time, late).groupBy(day.alias("w"), "Symbol", "source_type").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(filed).alias("_n"), F.sum(raised).alias("_raised")
    )
    score = F.least(F.col("_n") * DISCLOSURE_BASE + F.col("_raised") * DISCLOSURE_RAISE, F.lit(1.0))
    # The local date of the window start, whatever the session time zone is.
    local_day = F.date_from_unix_date(F.floor((F.unix_seconds("w.start") + UTC_OFFSET_HOURS * 3600) / 86400).cast("int"))
    return grouped.select(
        local_day.alias("Date"), "Symbol", "source_type", "event_count", score.alias("disclosure_score")
    )


def _merge_months(batch: DataFrame, table: str, staged: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """``merge(old rows, batch)`` for the months that the batch touches; other months are not read."""
    spark = batch.sparkSession
    month = F.date_format("Date", "yyyy-MM")
    fresh = batch.withColumn("month", month)
    try:
        base = spark.read.parquet(table)
    except AnalysisException as missing:  # no table yet, or one whose first write was never committed
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        base = fresh.limit(0)
    touched = [r[0] for r in fresh.select("month").distinct().collect()]  # calendar-bounded; literals prune partitions
    old = base.where(F.col("month").cast("string").isin(touched))
    # Written first so that the read of the target and its rewrite never share a plan.
    merge(old.drop("month"), fresh.drop("month")).withColumn("month", month).write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(table)


def merge_counts(batch: DataFrame, batch_id: int, table: str, staged: str) -> None:
    """Put a batch's changed counts into the table of counts.

    Every row carries the batch it comes from and the higher batch wins, so a batch that is
    run again, or after a later one, changes nothing.
    """
    key = ["Date", "Symbol", "source_type"]
    newest = lambda old, fresh: first_per_key(old.unionByName(fresh), key, [F.col("batch_id")], last=True)
    _merge_months(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), table, staged, newest)


def upsert_counts_stream(events: DataFrame, table: str, checkpoint: str, time: str = "signal_at", late: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Keep the table of daily counts up to date, days that are still open included."""
    counts = daily_counts_stream(events, time, late)
    merge = lambda batch, batch_id: merge_counts(batch, batch_id, table, f"{checkpoint.rstrip('/')}-staged/{batch_id}")
    writer = counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_bars_stream(bars: DataFrame, table: str, checkpoint: str, order: Column, available_now: bool = True) -> StreamingQuery:
    """Newest batch wins per (Date, Symbol), and inside a batch the last in ``order``. The table
    is partitioned by month; a batch reads and rewrites only the months it touches."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        _merge_months(batch, table, f"{checkpoint.rstrip('/')}-staged/{batch_id}", lambda old, fresh: merge_bars(old, fresh, order))

    writer = bars.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, processing what is there and stopping."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
