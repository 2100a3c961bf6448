"""A cache that lives in a stream's state: sets, deletes, flushes and look-ups are events, and entries go when their time is over."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import make_importable

# What an event does, in the order in which events of one time take effect.
SET, DELETE, FLUSH, GET = "set", "delete", "flush", "get"
ORDER = {DELETE: 0, FLUSH: 1, SET: 2, GET: 3}
#: Parts of a namespace, so that a busy one isn't in one task; each flush goes to all of them.
SALTS = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(events: DataFrame, salts: int = SALTS) -> DataFrame:
    """events (request, namespace, key, kind, at timestamp, value, ttl seconds) with __salt, flushes once for each; without a namespace, a time, a known kind, or, but
    for flushes, a key, an event does nothing and is left out (a look-up without a key has no answer to give)."""
    known = events.filter(F.col("namespace").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(list(ORDER)) & (F.col("key").isNotNull() | (F.col("kind") == FLUSH)))
    all_of = F.sequence(F.lit(0), F.lit(salts - 1))
    own = F.array(F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    return known.withColumn("__salt", F.explode(F.when(F.col("kind") == FLUSH, all_of).otherwise(own)))


def _now(t: pd.Timestamp):
    return t.to_pydatetime(warn=False)


class CacheState(StatefulProcessor):
    """Entries of a part of a namespace by key. Events of a batch take effect in order of time, so what a look-up sees doesn't depend on how they
    were dealt; an event that is older than what it would replace changes nothing."""

    def __init__(self, value_type: str):
        self.value_type = value_type

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", f"value {self.value_type}, written_at timestamp, expires_at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(__order=pdf["kind"].map(ORDER)).sort_values(["at", "__order", "value"], kind="stable")
        held: dict[str, tuple | None] = {}  # what is known of the state, each key read once; what changed of it is written at the end
        changed: set[str] = set()
        answers = []
        for r in pdf.itertuples(index=False):
            at = _now(r.at)
            if r.kind == FLUSH:
                for (name,), entry in list(self.entries.iterator()):
                    held.setdefault(name, entry)
                gone = [name for name, entry in held.items() if entry is not None and entry[1] <= at]
                held |= dict.fromkeys(gone)
                changed.update(gone)
                continue
            if r.key not in held:
                held[r.key] = self.entries.getValue((r.key,)) if self.entries.containsKey((r.key,)) else None
            entry = held[r.key]
            if r.kind == SET and (entry is None or entry[1] <= at):
                held[r.key] = (None if pd.isna(r.value) else r.value, at, at + timedelta(seconds=float(r.ttl)))
                changed.add(r.key)
            elif r.kind == DELETE and entry is not None and entry[1] <= at:
                held[r.key] = None
                changed.add(r.key)
            elif r.kind == GET:
                hit = entry is not None and entry[1] <= at < entry[2]
                answers.append((r.request, r.key, r.at, entry[0] if hit else None, hit))
        for name in changed:
            if held[name] is not None:
                self.entries.updateValue((name,), held[name])
                self.handle.registerTimer(int(pd.Timestamp(held[name][2]).value // 1_000_000))
            elif self.entries.containsKey((name,)):
                self.entries.removeKey((name,))
        yield pd.DataFrame(answers, columns=["request", "key", "at", "value", "hit"]).astype({"hit": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Entries whose time is over go; the timer that rang is theirs, or an older write's."""
        over = expiredTimerInfo.getExpiryTimeInMs()
        for (name,), (_, _, ends) in list(self.entries.iterator()):
            if int(pd.Timestamp(ends).value // 1_000_000) <= over:
                self.entries.removeKey((name,))
        yield pd.DataFrame([], columns=["request", "key", "at", "value", "hit"])

    def close(self) -> None:
        pass


def live(events: DataFrame, late: str = "1 hour", salts: int = SALTS) -> DataFrame:
    """request, key, at, value, hit of every look-up of a stream of events. The entries are the stream's state: they outlive it in its checkpoint. A timer
    at its end clears each entry, by the time of the events, ``late`` behind the latest. Needs the RocksDB state store (STATE_STORE)."""
    make_importable(events.sparkSession)
    kinds = dict(events.dtypes)
    keyed = prepared(events.withWatermark("at", late), salts).groupBy("namespace", "__salt")
    out = f"request {kinds['request']}, key string, at timestamp, value {kinds['value']}, hit boolean"
    return keyed.transformWithStateInPandas(CacheState(kinds["value"]), outputStructType=out, outputMode="Append", timeMode="EventTime")


def replay(events: DataFrame) -> DataFrame:
    """The same over a table of all events: each look-up sees the last set or delete of its key before it, unless its namespace was flushed since."""
    rows = prepared(events, 1).drop("__salt").withColumn("__order", F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind")))
    written = F.struct(F.col("at"), F.col("__order"), F.col("value"), (F.col("at") + F.make_dt_interval(secs=F.col("ttl"))).alias("ends"))
    by_time = lambda *by: Window.partitionBy(*by).orderBy("at", "__order", "value").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.filter(F.col("kind") != FLUSH).withColumn("last", F.last(F.when(F.col("kind").isin(SET, DELETE), written), ignorenulls=True).over(by_time("namespace", "key")))
    # flushes in order, and those before each look-up: few beside the look-ups, so each namespace's are one array
    times = rows.filter(F.col("kind") == FLUSH).groupBy("namespace").agg(F.array_sort(F.collect_set("at")).alias("flushes"))
    told = own.filter(F.col("kind") == GET).join(times, "namespace", "left")
    flushed: Column = F.array_max(F.filter("flushes", lambda t: t <= F.col("at")))
    hit = (F.col("last.__order") == ORDER[SET]) & (F.col("last.ends") > F.col("at")) & F.coalesce(F.col("last.at") >= flushed, F.lit(True))
    # of a flush and a set at one time the set comes later
    hit = F.coalesce(hit, F.lit(False))
    return told.select("request", "key", "at", F.when(hit, F.col("last.value")).alias("value"), hit.alias("hit"))


def run(spark: SparkSession, events: DataFrame, to: str, checkpoint: str, late: str = "1 hour") -> None:
    """Take in what the stream has, append the answers to ``to`` as Parquet, and stop; run again, it goes on where it stopped."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        query = live(events, late).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
