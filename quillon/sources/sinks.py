"""Writers: line streams, reports, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dual_json(df: DataFrame, all_path: str, some_path: str, keep: Column) -> None:
    """All rows to one path and the kept ones to another; the source is read once."""
    held = df.cache()
    try:
        held.write.mode("overwrite").json(all_path)
        held.filter(keep).write.mode("overwrite").json(some_path)
    finally:
        held.unpersist()


def append_progress(ids: DataFrame, path: str) -> None:
    """Ids as lines, after the batch they belong to was written."""
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).write.mode("append").text(path)


def report(metrics: DataFrame, rows: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    rows.write.mode("overwrite").json(f"{path}/queries")
