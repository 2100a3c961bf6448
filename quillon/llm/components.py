"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """edges(a, b), longs in any order -> (node, component), component being the smallest node reachable.

    Alternating large and small stars: each round hangs a node's neighbours under the smallest one, so the edge table
    never grows and ends as one star per component, after about log rounds. Rounds are settled in the shared folder.
    Loops, repeats and nulls do no harm; nodes without an edge don't appear.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct()
    now, mark = settle(now, "edges"), None  # discarded by the round that has replaced it
    if now.isEmpty():
        return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = settle(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter(F.col("a") < F.col("b")).distinct(), "edges")
        discard(now)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(least, "b")
        small = pairs.select(F.col("m").alias("a"), "b").unionByName(pairs.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = settle(small.distinct(), "edges")
        discard(large)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
