"""Sparse search that stops early: postings by blocks of documents with the largest weight of each term in them.

Documents are put in order of the sum of their weights and cut into blocks, so that high scores gather in the first ones. What a query can score at most
in a block is known from the maxima alone. Its best blocks are scored first; the k-th score found there rules out all blocks that
can't reach it, whose postings aren't looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import make_importable
from .hierarchy import kept
from .search import RANK_PLACES, bucket_of, rank_by, shown

#: Documents of a block; blocks of each query that are scored first.
BLOCK_DOCS, FIRST = 128, 8
#: Sums of products are compared with this much room, as they depend on the order of their terms.
ROOM = 1e-6


@dataclass
class BlockIndex:
    """maxima: bucket, block, term, most, n, one row for each term and block. lists: the same with docs, array<struct<id,weight>>; both by bucket."""

    lists: DataFrame

    @property
    def maxima(self) -> DataFrame:
        return self.lists.select("bucket", "block", "term", "most", "n")


def build_blocks(postings: DataFrame, path: str, per_block: int = BLOCK_DOCS) -> BlockIndex:
    """Of postings (id, term, weight, bucket) the stored block index: a folder for each bucket of terms, in order of block and term, so that what
    a query rules out, the last blocks above all, lies together."""
    spark = postings.sparkSession
    mass = postings.groupBy("id").agg(F.round(F.sum("weight"), RANK_PLACES).alias("mass"))
    ranged = kept(mass.repartitionByRange(F.desc("mass"), F.col("id")).withColumn("pid", F.spark_partition_id()), "masses")
    counts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))  # a row for each partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("mass"), "id")) - 1
    of = ranged.join(F.broadcast(before), "pid").select("id", F.floor(place / per_block).alias("block"))
    each = postings.join(of, "id").groupBy("bucket", "block", "term")
    lists = each.agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "weight")).alias("docs"))
    lists.repartition("bucket").sortWithinPartitions("bucket", "block", "term").write.partitionBy("bucket").parquet(path)
    return open_blocks(spark, path, lists.schema)


def blocks_of_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", per_block: int = BLOCK_DOCS) -> BlockIndex:
    """The block index straight from documents whose ids are told apart: texts are dealt by the sum of their weights, the only shuffle, and a task makes the blocks of
    those it gets, numbered on from its own part of the order; it holds the postings of one block."""
    spark = docs.sparkSession
    make_importable(spark)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [list(Counter(t.encode().split()).values()) for t in b["text"]]
            yield b.assign(mass=[round(float(np.sum(1.0 + np.log(x))), RANK_PLACES) if x else 0.0 for x in each])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(weighed, "id long, text string, mass double")
    order = [F.desc("mass"), F.col("id")]
    ranged = rows.filter("mass > 0").repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().cast("long").alias("pid"))
    names = ["block", "term", "most", "n", "docs"]

    def block(number: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
        codes: dict[bytes, int] = {}
        code, tf, of = [], [], []
        for i, text in zip(ids, texts, strict=True):
            counts = Counter(text.encode().split())
            code += [codes.setdefault(t, len(codes)) for t in counts]
            tf += counts.values()
            of += [i] * len(counts)
        order = np.argsort(code, kind="stable")
        n = np.bincount(code)
        begin = np.concatenate(([0], np.cumsum(n)))
        weight = (1.0 + np.log(np.array(tf)))[order]
        held = pa.StructArray.from_arrays([pa.array(np.array(of, dtype=np.int64)[order]), pa.array(weight)], names=["id", "weight"])
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), pa.array([t.decode() for t in codes]), pa.array(np.maximum.reduceat(weight, begin[:-1])), pa.array(n.astype(np.int64)), lists], names=names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, number = [], [], None
        for b in batches:
            for i, text, pid in zip(*(b.column(c).to_pylist() for c in ("id", "text", "pid")), strict=True):
                number = pid << 32 if number is None else number
                ids.append(i)
                texts.append(text)
                if len(ids) == per_block:
                    yield block(number, ids, texts)
                    ids, texts, number = [], [], number + 1
        if ids:
            yield block(number, ids, texts)

    lists = ranged.mapInArrow(made, "block long, term string, most double, n long, docs array<struct<id:long,weight:double>>").select(bucket_of(F.col("term")).alias("bucket"), *names)
    lists.sortWithinPartitions("bucket", "block", "term").write.partitionBy("bucket").parquet(path)
    return open_blocks(spark, path, lists.select("block", "term", "most", "n", "docs", "bucket").schema)


def open_blocks(spark: SparkSession, path: str, schema=None) -> BlockIndex:
    return BlockIndex((spark.read.schema(schema) if schema else spark.read).parquet(path))


def asked_terms(queries: DataFrame, q_id: str = "query_id", q_text: str = "q") -> DataFrame:
    """query_id, term, wq, bucket."""
    terms = queries.select(F.col(q_id).alias("query_id"), F.explode(words(F.col(q_text))).alias("term"))
    return terms.groupBy("query_id", "term").agg((1.0 + F.log(F.count(F.lit(1)))).alias("wq")).withColumn("bucket", bucket_of(F.col("term")))


def pruned_topk(index: BlockIndex, queries: DataFrame, k: int, q_id: str = "query_id", q_text: str = "q", first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """query_id, id, score, rank: the k best documents of each query, just as from all postings; and query_id, postings (of its terms), scored (of these
    looked at), blocks, blocks_scored.

    Documents that share no term with a query are absent, as are queries without terms. Repeated queries are one. An empty side gives empty results.
    """
    asked = kept(asked_terms(queries, q_id, q_text), "asked")
    on = ["bucket", "term"]
    bounds = index.maxima.join(asked, on).groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("wq")).alias("bound"), F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds = kept(bounds.withColumn("place", place), "bounds")

    def scores(blocks: DataFrame) -> DataFrame:
        last = blocks.agg(F.max("block")).first()[0]
        wanted = blocks.select("query_id", "block").join(asked, "query_id")
        read = index.lists.filter(F.col("block") <= F.lit(-1 if last is None else last)).select("bucket", "block", "term", "docs")
        found = wanted.join(read, [*on, "block"]).select("query_id", "wq", F.explode("docs").alias("d"))
        return found.groupBy("query_id", F.col("d.id").alias("id")).agg(F.round(F.sum(F.col("d.weight") * F.col("wq")), RANK_PLACES).alias("score"))

    begun = kept(scores(bounds.filter(F.col("place") <= first)), "first-scores")
    reached = rank_by(begun, "score", "id", ["query_id"]).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    later = bounds.filter(F.col("place") > first).join(reached, "query_id", "left").filter(F.col("bound") + ROOM >= F.coalesce("least", F.lit(float("-inf"))))
    later = kept(later.select("query_id", "block", "n"), "later-blocks")
    ranked = rank_by(begun.unionByName(scores(later)), "score", "id", ["query_id"]).filter(F.col("rank") <= k)
    seen = bounds.filter(F.col("place") <= first).select("query_id", "block", "n").unionByName(later)
    told = bounds.groupBy("query_id").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("blocks"))
    looked = seen.groupBy("query_id").agg(F.sum("n").alias("scored"), F.count(F.lit(1)).alias("blocks_scored"))
    return shown(ranked), told.join(looked, "query_id").select("query_id", "postings", "scored", "blocks", "blocks_scored")
