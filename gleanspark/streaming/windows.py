"""Counts by time window over a stream, kept as a table that equals the batch result."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanspark.sources.scratch import scratch_path


def window_counts(
    events: DataFrame,
    width: str,
    keys: Sequence[str] = (),
    *,
    ts_col: str = "ts",
    value_col: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """start of each window, keys, n and (with ``value_col``) total; a stream's state goes ``delay`` after a window's end.

    Rows without a time are in no window.  On a stream, rows of windows that the watermark has passed are left out
    (``late`` counts them); on a table none is.
    """
    rows = events.filter(F.col(ts_col).isNotNull()).withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts_col, delay)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value_col).alias("total")] if value_col else [])
    return rows.groupBy(F.window(ts_col, width).alias("_w"), *keys).agg(*aggs).select(
        F.col("_w.start").alias("start"), *keys, "n", *(["total"] if value_col else [])
    )


def keep(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the stream on what is there; each batch's changed windows are written below ``path`` once, also after a restart."""

    def write(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{path}/of_batch={k}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
    query = query.option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return query


def latest(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last state of each window of a kept table."""
    values = [c for c in rows.columns if c not in ("start", "batch", "of_batch", *keys)]
    got = rows.groupBy("start", *keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return got.select("start", *keys, "_v.*")


def late(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, after partial sums by window and key."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def windows_of_stream(events: DataFrame, parts: int, width: str, keys: Sequence[str] = (), **named) -> DataFrame:
    """The windows of a stored table read as a stream of about ``parts`` batches in order of time.

    Rows are late by one part of the time at most, so that this is the delay, and none is left out.
    """
    spark, ts = events.sparkSession, named.get("ts_col", "ts")
    folder, path = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-windows")
    low, high = events.agg(F.min(ts), F.max(ts)).first()
    step = (high - low) / parts if low is not None else timedelta()
    ends = [low + step * k for k in range(1, parts)] if low is not None else []
    for lower, upper in zip([None, *ends], [*ends, None], strict=True):
        rows = events.filter(F.col(ts) >= F.lit(lower)) if lower else events
        (rows.filter(F.col(ts) < F.lit(upper)) if upper else rows).write.mode("append").parquet(folder)
    files = -(-len(spark.read.schema(events.schema).parquet(folder).inputFiles()) // parts)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(files, 1)).parquet(folder)
    named["delay"] = f"{int(step.total_seconds()) + 1} seconds"
    keep(window_counts(stream, width, keys, **named), path, scratch_path(spark, "stream-state"))
    kept = window_counts(events.limit(0), width, keys, **named).schema.add("batch", "long")
    return latest(spark.read.schema(kept).parquet(path), keys)
