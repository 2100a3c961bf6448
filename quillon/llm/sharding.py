"""Longest-processing-time sharding: groups that stay together, largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, look_up, settle, table


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """(size, groups of it) -> for each size the groups that each shard gets, exactly as longest-processing-time scheduling
    gives them: sizes come largest first, a heap holds the loads, and ties go to the lower shard.

    Groups of one size are alike. Of a size with many groups, those that surely go below the final water level are given at
    once, the rest one by one.
    """
    load, out = [0] * shards, {}
    for size, count in sorted(sizes, reverse=True):
        got, left = [0] * shards, count
        if count > 4 * shards:
            low, high = min(load), max(load) + size * (count // shards + 2)
            while high - low > 1:
                level = (low + high) // 2
                if sum(max(0, (level - x) // size) for x in load) <= count:
                    low = level
                else:
                    high = level
            got = [max(0, (low - x) // size) for x in load]
            load = [x + n * size for x, n in zip(load, got, strict=True)]
            left -= sum(got)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(left):
            x, s = heapq.heappop(heap)
            got[s] += 1
            load[s] = x + size
            heapq.heappush(heap, (load[s], s))
        out[size] = got
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A group is the rows of one text (null counts as empty) and its size the bytes of its rows (UTF-8 length plus
    ``overhead`` each). The driver schedules a table of group sizes with counts, as groups of one size are alike: n
    different sizes add up to n * n / 2 bytes at least, so there are at most the square root of twice the input's bytes (250,000 for 30 GB, 14 million for
    100 TB). Groups of a size are numbered by sorted ranges, so no size meets in one task; rows learn their shard by the text's digest, those of a hot text without
    meeting; rows of a shard get their slots from counts per (shard, input partition). A group larger than a fair share makes its shard larger than the
    others, as groups are never split. Repeated rows each get a slot, null ids too. Texts of any length are hashed whole. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.spark_partition_id().alias("pid")), "shard-rows"
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = settle(groups.repartitionByRange(parts, "bytes", "digest").withColumn("gp", F.spark_partition_id()), "shard-groups")
    counted = groups.groupBy("bytes", "gp").agg(F.count(F.lit(1)).alias("groups"))
    sizes = counted.groupBy("bytes").agg(F.sum("groups").alias("groups")).toPandas()
    plan = schedule(list(zip(sizes["bytes"].tolist(), sizes["groups"].tolist(), strict=True)), shards)
    ends: dict[str, list] = {"bytes": [], "ends": []}
    for size, got in plan.items():
        at, own = 0, []
        for s, n in enumerate(got):
            if n:
                at += n
                own.append({"high": at, "shard": s})
        ends["bytes"].append(size)
        ends["ends"].append(own)
    ends = spark.createDataFrame(pd.DataFrame(ends, columns=["bytes", "ends"]), "bytes long, ends array<struct<high:long,shard:int>>")
    before = counted.withColumn("before", F.sum("groups").over(Window.partitionBy("bytes").orderBy("gp")) - F.col("groups")).select("bytes", "gp", "before")
    rank = F.row_number().over(Window.partitionBy("bytes", "gp").orderBy("digest")) - 1
    at = F.col("rank") + F.col("before")
    placed = groups.withColumn("rank", rank).join(before, ["bytes", "gp"]).join(ends, "bytes")
    placed = settle(placed.select("digest", "n", F.filter("ends", lambda e: e["high"] > at)[0]["shard"].alias("shard")), "shard-placed")
    there = settle(look_up(rows, placed, "digest", "n", F.xxhash64("doc_id")).drop("digest"), "shard-there")
    discard(rows, groups, placed)
    before = there.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("pid")) - F.col("n"))
    slot = F.row_number().over(Window.partitionBy("shard", "pid").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        there.withColumn("in_part", slot)
        .join(before.select("shard", "pid", "before"), ["shard", "pid"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_part")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes. Odd rows as in shard."""
    return shard(table(spark, sf_dir, "documents"))
