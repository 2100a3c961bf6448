"""Resumable ingestion: a file stream whose batches are upserted, with checkpoints and progress in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store, latest
from ..sources.sinks import append_progress


def ingest_files(spark: SparkSession, source: str, schema: str, store: Store, collection: str, checkpoint: str, files_per_batch: int = 100, progress_path: str | None = None, fmt: str = "parquet", order: Sequence[str] | None = None) -> None:
    """Upsert the files that weren't ingested before into a collection, then stop; run again after new files, or a failure.

    A batch that failed half-way is run again with the same number; the upsert makes that harmless, as ``batch`` and the
    key decide which row stays. With ``order`` the last row in these columns stays, in whichever batch it comes.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source)

    def put(rows: DataFrame, number: int) -> None:
        rows = latest(rows.withColumn("batch", F.lit(number)), store.key, order or [c for c in rows.columns if c != store.key] or [store.key])
        store.upsert(collection, rows, [*order, "batch"] if order else "batch")
        if progress_path:
            append_progress(rows.select(store.key), progress_path)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def live_counts(events: DataFrame, by: str, at: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Counts by window and key over a stream or a table; on a stream, windows close ``late`` after their end."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
