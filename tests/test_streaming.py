from pyspark.sql import functions as F

from quillon.operators.store import Store
from quillon.sources import readers
from quillon.streaming.incremental import ingest_files, live_counts


def test_resumable_ingestion(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "id long, v string"
    s = Store(spark, f"file://{tmp_path}/store")
    for rows in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_files(spark, source, schema, s, "c", f"file://{tmp_path}/check", progress_path=f"file://{tmp_path}/done")
    ingest_files(spark, source, schema, s, "c", f"file://{tmp_path}/check")  # nothing new
    assert [(r.id, r.v) for r in s.read("c").orderBy("id").collect()] == [(1, "a"), (2, "B"), (3, "c")]
    assert readers.progress(spark, f"file://{tmp_path}/done").count() == 3


def test_older_rows_of_later_batches_lose(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "id long, ts long, v string"
    s = Store(spark, f"file://{tmp_path}/store")
    for rows in ([(1, 5, "new"), (1, 4, "x"), (2, 1, "b")], [(1, 3, "old"), (2, 2, "B")], [(2, None, "?"), (3, None, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_files(spark, source, schema, s, "c", f"file://{tmp_path}/check", files_per_batch=1, order=["ts"])
    assert [(r.id, r.v) for r in s.read("c").orderBy("id").collect()] == [(1, "new"), (2, "B"), (3, "c")]


def test_all_events_reach_the_stream(spark, tmp_path, monkeypatch):
    from quillon.plans import catalog, corpus_plans

    landed, d = [], f"file://{tmp_path}"
    monkeypatch.setattr(corpus_plans, "ingest_files", lambda *a, **k: (landed.append(spark.read.schema(a[2]).parquet(a[1]).count()), ingest_files(*a, **k)))
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-02 00:00:00", 2.0), (1, "2024-02-01 00:00:00", 3.0), (1, "2024-01-31 00:00:00", 4.0), (1, None, 9.0), (2, None, 5.0), (3, "2024-02-01 00:00:00", None), (3, "2024-01-01 00:00:00", 6.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").write.parquet(f"{d}/events.parquet")
    got = {r.user_id: r.value for r in catalog.QUERIES["incremental_upsert"](spark, d).collect()}
    assert landed[-1] == len(rows) and got == {1: 3.0, 2: None, 3: 6.0}


def test_live_counts(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "k string, t string")
    got = live_counts(rows.withColumn("ts", F.col("t").cast("timestamp")), "k")
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 2), ("b", 1)]
