"""Traces of a stream: sessions of spans that are told once they are over, and the progress of the stream itself."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def sessions(spans: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 hour", at: str = "at", tokens: str = "tokens", failed: str = "failed") -> DataFrame:
    """by, began, ended (the last span's time and ``gap``), spans, tokens (unknown ones 0), failures: spans of one key with no more than ``gap`` between
    them. On a stream a session is told once the watermark, ``late`` behind the latest span, has passed its end; spans that are later still, and
    those without a key or time, are left out."""
    rows = spans.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    made = rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures")
    )
    return made.select(by, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "spans", "tokens", "failures")


class Progress(StreamingQueryListener):
    """Keeps a row for each batch of the queries that run while it is added: query, batch, rows, seconds, rate (rows a second); and, where ``expected`` says how
    many rows there are, how many are left and how long they will take at the rate so far."""

    def __init__(self, expected: int | None = None):
        self.expected, self.rows = expected, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        n, seconds = p["numInputRows"], p.get("batchDuration", 0) / 1000
        done = sum(r["rows"] for r in self.rows) + n
        spent = sum(r["seconds"] for r in self.rows) + seconds
        rate = done / spent if spent else 0.0
        left = None if self.expected is None else max(0, self.expected - done)
        eta = left / rate if left is not None and rate else None
        self.rows.append({"query": p["id"], "batch": p["batchId"], "rows": n, "seconds": seconds, "rate": n / seconds if seconds else 0.0, "left": left, "eta_seconds": eta})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "query string, batch long, rows long, seconds double, rate double, left long, eta_seconds double"
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], schema)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the rows so far to a log."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)


def take_in(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Append what the stream gives to ``to`` as Parquet, until it has nothing new."""
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
