"""Collections in buckets: what is written, by whom, and what stays."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import store

SCHEMA = "id long, v string, batch int"


def make(spark, tmp_path, **more):
    return store.Store(spark, f"file://{tmp_path}/c", "id", **more)


def contents(s, name="x"):
    return sorted((r.id, r.v) for r in s.read(name).collect())


def written(tmp_path):
    return sum(f.stat().st_size for f in Path(tmp_path).rglob("*.parquet"))


def test_one_per_cent_of_the_keys_rewrites_little(spark, tmp_path):
    s = make(spark, tmp_path, buckets=16)
    text = F.concat(*[F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(4)])
    rows = spark.range(20_000).select("id", text.alias("v"), F.lit(0).alias("batch"))
    s.write("x", rows)
    whole = written(tmp_path)
    some = rows.filter("id % 100 = 7").withColumn("v", F.lit("new")).withColumn("batch", F.lit(1))
    s.upsert("x", some)
    assert written(tmp_path) - whole < whole / 10  # nothing was deleted yet, so this is all that was written
    assert s.read("x").count() == 20_000
    assert s.read("x").filter("v = 'new'").count() == 200
    before = s.state("x").parts
    s.upsert("x", rows.filter("id = 5").withColumn("v", F.lit("newer")).withColumn("batch", F.lit(2)))
    assert len([b for b, x in s.state("x").parts.items() if before[b] != x]) == 1  # one key, one bucket
    s.update("x", spark.createDataFrame([(5, "patched")], "id long, v string"), ["v"])
    assert s.read("x").filter("id = 5").first().v == "patched"
    assert len([b for b, x in s.state("x").parts.items() if before[b] != x]) == 1


def test_a_writer_between_anothers_write_and_commit_loses_nothing(spark, tmp_path):
    s, other = make(spark, tmp_path, buckets=4), make(spark, tmp_path, buckets=4)
    s.write("x", spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SCHEMA))
    publish, turns = s._publish, []

    def late(name, state):
        if not turns:
            turns.append(1)
            other.upsert("x", spark.createDataFrame([(2, "other", 1), (3, "other", 1)], SCHEMA))
        return publish(name, state)

    s._publish = late
    s.upsert("x", spark.createDataFrame([(1, "mine", 1), (4, "mine", 1)], SCHEMA))
    assert contents(s) == [(1, "mine"), (2, "other"), (3, "other"), (4, "mine")]
    turns.clear()
    # a change of the same rows has to be made again on what the other has written
    s._publish = lambda name, state: other.fold("x", share=0) and False if not turns and not turns.append(1) else publish(name, state)
    s.update("x", spark.createDataFrame([(i, "all") for i in range(1, 5)], "id long, v string"), ["v"])
    assert contents(s) == [(i, "all") for i in range(1, 5)]


def test_many_writers_at_once(spark, tmp_path):
    stores = [make(spark, tmp_path, buckets=4) for _ in range(4)]
    failed = []

    def work(k, s):
        try:
            for n in range(3):
                s.upsert("x", spark.createDataFrame([(100 * k + n, f"w{k}", n), (7, f"w{k}", 10 * n + k)], SCHEMA))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=x) for x in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = dict(contents(stores[0]))
    assert got == {100 * k + n: f"w{k}" for k in range(4) for n in range(3)} | {7: "w3"}
    assert stores[0].state("x").number >= 12  # each upsert is a commit, and folding makes more


def test_parts_are_folded_and_old_ones_deleted(spark, tmp_path):
    s = make(spark, tmp_path, buckets=2)
    for n in range(8):
        s.upsert("x", spark.createDataFrame([(i, f"b{n}", n) for i in range(6)], SCHEMA))
    assert all(len(x) < 4 for x in s.state("x").parts.values())
    assert contents(s) == [(i, "b7") for i in range(6)]
    assert len(s._numbers("x")) == store.KEEP
    named = {v for n in s._numbers("x") for x in s._load("x", n).parts.values() for v, _ in x}
    held = {f.parent.parent.name for f in Path(tmp_path).rglob("*.parquet")}
    assert held == named
    stray = Path(tmp_path) / "c/x/v-other/store_bucket=0/part.parquet"  # another writer's, not committed yet
    stray.parent.mkdir(parents=True)
    stray.write_bytes(b"")
    s.write("x", spark.createDataFrame([(1, "z", 9)], SCHEMA))
    assert stray.exists()


def test_a_plan_made_before_a_write_still_reads_its_rows(spark, tmp_path):
    s = make(spark, tmp_path, buckets=2)
    s.write("x", spark.createDataFrame([(1, "a", 0)], SCHEMA))
    old = s.read("x")
    s.write("x", spark.createDataFrame([(1, "b", 0)], SCHEMA))
    assert [r.v for r in old.collect()] == ["a"] and contents(s) == [(1, "b")]


def test_columns_and_types(spark, tmp_path):
    s = make(spark, tmp_path, buckets=2)
    s.upsert("x", spark.createDataFrame([(1, "a", 0), (None, "n", 0)], SCHEMA))
    s.upsert("x", spark.createDataFrame([(1, 1, "w")], "id int, batch long, w string"))
    assert sorted((tuple(r) for r in s.read("x").select("id", "v", "batch", "w").collect()), key=str) == [(1, None, 1, "w"), (None, "n", 0, None)]
    with pytest.raises(ValueError):
        s.upsert("x", spark.createDataFrame([(1, "a", 0)], SCHEMA), batch_col="v")
    s.upsert("x", spark.createDataFrame([], SCHEMA))
    assert s.read("x").count() == 2
    assert s.read("none") is None and s.fold("none") == []
    s.update("none", spark.createDataFrame([(1, "a", 0)], SCHEMA), ["v"])
    assert s.read("none") is None


def test_a_broken_collection_is_none_to_a_search(spark, tmp_path):
    s = make(spark, tmp_path, buckets=1)
    for name in ("good", "bad"):
        s.write(name, spark.createDataFrame([(1, name, 0)], SCHEMA))
    for f in (Path(tmp_path) / "c/bad").rglob("*.parquet"):
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    got = s.readable(["good", "bad", "missing"])
    assert got["bad"] is None and got["missing"] is None
    assert [r.v for r in got["good"].collect()] == ["good"]
