"""Exact deduplication that no hot group can stall: local, salted, then global combining, with full contents compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, look_up, settle, table


def normalised(text: Column) -> Column:
    """Runs of the six white-space characters become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    1. Each map task combines its own equal texts (the partial aggregate on digest, salt and content).
    2. Groups meet under (digest, salt, content); the salt is the map task's, so a text that holds a third of all rows
       is spread over ``salts`` reducers, with at most one row from each task.
    3. The winners of the salts, at most ``salts`` per text, meet under (digest, content).
    Contents are grouping keys in all three, so texts that share a digest never merge. Rows then learn their group by
    digest, those of a hot text without meeting; only where a digest has several contents (``digest`` is replaceable, for tests) the content joins as well.

    Null text counts as empty. Of equal texts the smallest id stays (null ids come last); of rows that repeat both
    id and text one is kept. Texts of any length are compared whole. Other columns are ignored. An empty table gives an empty result.
    """
    sha = lambda c: F.sha2(c, 256)
    key = digest or sha
    content = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", key(F.col("content")))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    merged = salted.repartition(F.col("digest")).groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    several = F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1
    groups = settle(
        merged.withColumn("several", several).select("digest", "keep_id", "group_size", "several", F.when(F.col("several"), F.col("content")).alias("content")), "dedup-groups"
    )
    ids = rows.select("doc_id", "digest", (sha(F.col("content")) if digest else F.col("digest")).alias("text_sha256"))
    single = groups.filter(~F.col("several")).select("digest", "keep_id", "group_size", F.col("group_size").alias("rows"))
    out = look_up(ids, single, "digest", "rows", F.xxhash64("doc_id")).select("doc_id", "digest", "keep_id", "group_size", "text_sha256")
    if not groups.filter("several").isEmpty():
        out = out.filter(F.col("group_size").isNotNull())
        exact = rows.withColumn("text_sha256", sha(F.col("content"))).join(groups.filter("several").drop("several"), ["digest", "content"])
        out = out.unionByName(exact.select(out.columns))
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")) == 1
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents. Odd rows as in exact_dedup."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
