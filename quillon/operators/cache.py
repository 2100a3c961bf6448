"""Keyed cache table with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def cache_key(query: Column, collections: Column, extra: Column, prefix: str = "q:") -> Column:
    """Prefix and 32 hex digits over the lowered, stripped query, the sorted collections and ``extra`` (filters belong there)."""
    canonical = F.to_json(F.struct(F.array_sort(collections).alias("collections"), F.coalesce(extra, F.lit("")).alias("extra"), F.lower(F.regexp_replace(query, r"^\s+|\s+$", "")).alias("query")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, 32))


def lookup(requests: DataFrame, entries: DataFrame, now: str = "now", key: str = "key") -> DataFrame:
    """Requests with ``value`` and ``hit``: the last entry of the key that was written by the request's time (of several written at once the one that
    lives longest, then the largest value), if it hasn't expired: a write takes the place of what was there, so an older entry isn't found even if it
    would have lived longer. Entries without an expiry live on; a null key hits nothing; repeated requests stay.

    Requests and entries of a key are put in order of time, writes before requests, so each request sees the last write before it and no request meets all
    entries of its key.
    """
    asked = requests.select(F.col(key).alias("__key"), F.col(now).alias("__now")).dropna().distinct()
    none = F.lit(None)
    kind, at = dict(entries.dtypes)["value"], dict(entries.dtypes)["expires_at"]
    ends = F.coalesce("expires_at", F.lit("9999-12-31").cast(at))
    events = entries.select(F.col(key).alias("__key"), F.col("written_at").alias("__at"), F.lit(0).alias("__asks"), F.struct(ends.alias("ends"), "written_at", "value").alias("e")).unionByName(
        asked.select("__key", F.col("__now").alias("__at"), F.lit(1).alias("__asks"), none.cast(f"struct<ends:{at},written_at:{dict(entries.dtypes)['written_at']},value:{kind}>").alias("e"))
    )
    before = Window.partitionBy("__key").orderBy("__at", "__asks", "e").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("last", F.last("e", ignorenulls=True).over(before)).filter(F.col("__asks") == 1)
    found = seen.select("__key", F.col("__at").alias("__now"), F.when(F.col("last.ends") > F.col("__at"), F.col("last.value")).alias("value"))
    joined = requests.join(found, (F.col(key) == F.col("__key")) & (F.col(now) == F.col("__now")), "left").drop("__key", "__now")
    return joined.withColumn("hit", F.col("value").isNotNull())


def set_entry(entries: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """entries with new ones written over those of the same key."""
    return delete(entries, new, key).unionByName(new, allowMissingColumns=True)


def delete(entries: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """What is left without the given keys."""
    return entries.join(keys.select(key).distinct(), key, "left_anti").select(*entries.columns)


def statistics(events: DataFrame, hit: str = "hit", client: str = "client") -> DataFrame:
    """requests, hits, misses, hit_rate (six places, 0 without requests), clients."""
    h = F.coalesce(F.col(hit), F.lit(False))
    counts = events.agg(F.count(F.lit(1)).alias("requests"), F.count_if(h).alias("hits"), F.count_if(~h).alias("misses"), F.count_distinct(client).alias("clients"))
    return counts.select("requests", "hits", "misses", F.round(F.coalesce(F.try_divide("hits", "requests"), F.lit(0.0)), 6).alias("hit_rate"), "clients")


def cached_value(documents: Column, most: int = 5) -> Column:
    """What a cache keeps of an answer's documents (array<struct>): the first ``most``, without their chunk_text."""
    return F.transform(F.slice(documents, 1, most), lambda x: x.dropFields("chunk_text"))


def store_entries(answers: DataFrame, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    return answers.withColumn("written_at", F.col(at)).withColumn("expires_at", F.col(at) + F.make_dt_interval(secs=F.lit(ttl)))


def flush(entries: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """What is left after a namespace is emptied."""
    return entries.filter(~F.startswith(key, F.lit(prefix)))
