"""The cache in a stream's state against the same events as a table, and against a plain dictionary."""

import datetime as dt
import random

import pytest

from quillon.streaming import live_cache

SCHEMA = "request long, namespace string, key string, kind string, at timestamp, value double, ttl int"
START = dt.datetime(2024, 1, 1)


def events_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices(["set", "get", "delete", "flush"], [4, 6, 1, 0.3])[0]
        at = START + dt.timedelta(seconds=rng.randrange(n) * 30)
        rows.append((i, rng.choice("ab"), None if kind == "flush" else f"k{rng.randrange(6)}", kind, at, float(rng.randrange(100)), rng.choice([40, 300, 2_000])))
    return rows


def plain(rows):
    held, out = {}, []
    for request, space, key, kind, at, value, ttl in sorted(rows, key=lambda r: (r[4], live_cache.ORDER[r[3]], r[5])):
        if kind == "set":
            held[space, key] = (value, at + dt.timedelta(seconds=ttl))
        elif kind == "delete":
            held.pop((space, key), None)
        elif kind == "flush":
            held = {k: v for k, v in held.items() if k[0] != space}
        else:
            v = held.get((space, key))
            out.append((request, key, v[0], True) if v and v[1] > at else (request, key, None, False))
    return sorted(out)


def answers(df):
    return sorted((r.request, r.key, r.value, r.hit) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_same_as_a_dictionary(spark, seed):
    rows = events_of(seed, 400)
    odd = [(900, None, "k", "get", START, 1.0, 1), (901, "a", None, "get", START, 1.0, 1), (902, "a", "k", "get", None, 1.0, 1), (903, "a", "k", "other", START, 1.0, 1)]
    assert answers(live_cache.replay(spark.createDataFrame(rows + odd, SCHEMA))) == plain(rows)
    assert live_cache.replay(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_same_as_replay_and_goes_on_after_a_stop(spark, tmp_path):
    rows = sorted(events_of(3, 300), key=lambda r: r[4])
    source, to, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for at in range(0, 300, 100):
        part = [r for r in rows if START + dt.timedelta(seconds=at * 30) <= r[4] < START + dt.timedelta(seconds=(at + 100) * 30)]
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        live_cache.run(spark, spark.readStream.schema(SCHEMA).parquet(source), to, check)
    got = answers(spark.read.schema("request long, key string, at timestamp, value double, hit boolean").parquet(to))
    assert got == plain(rows) == answers(live_cache.replay(spark.createDataFrame(rows, SCHEMA)))
    assert any(h for *_, h in got) and not all(h for *_, h in got)


def test_entries_leave_the_state_when_their_time_is_over(spark, tmp_path):
    source, to, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    at = lambda hours: START + dt.timedelta(hours=hours)
    parts = [[(1, "a", f"k{i}", "set", at(0), 1.0, 60) for i in range(20)], [(2, "a", "z", "set", at(5), 2.0, 60)], [(3, "a", "z", "set", at(10), 3.0, 60), (4, "a", "k0", "get", at(10), None, None)]]
    rows = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = live_cache.live(spark.readStream.schema(SCHEMA).parquet(source))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_cache.STATE_STORE)
        q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    assert rows[-1] < rows[0]
