"""Nearest neighbours by cosine with an inverted multi-index.

The two halves of the unit vectors have codebooks of their own, and an entry's cell is the pair of its nearest
centroids. A query walks the pairs in order of summed distance, with a heap, until the cells walked hold a set
share of all entries; those entries are ranked by exact cosine on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import make_importable, table

#: Centroids of a half (a set of them is the bits of one long), vectors that fit them, share of the entries to walk, and entries to walk at least.
CENTROIDS, FIT_SAMPLE, SHARE, LEAST = 64, 20_000, 0.5, 1_000
#: Entries and queries that meet in one task at most.
ENTRY_BLOCK, QUERY_BLOCK = 20_000, 10_000


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def fit_codebooks(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """K-means of each half of the sample's unit vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    books, rng = [], np.random.default_rng(seed)
    k = max(1, min(k, len(unit)))
    for half in halves(unit):
        book = half[rng.choice(len(half), k, replace=False)].copy()
        for _ in range(rounds):
            near = distances(half, book).argmin(axis=1)
            sums = np.zeros_like(book)
            np.add.at(sums, near, half)
            count = np.bincount(near, minlength=k)
            book[count > 0] = sums[count > 0] / count[count > 0, None]
        books.append(book)
    return books[0], books[1]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = x.shape[1] // 2
    return x[:, :middle], x[:, middle:]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ book.T + (book**2).sum(axis=1)


def walk(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, want: float) -> dict[int, int]:
    """Cells in order of d1[i] + d2[j] until they hold ``want`` entries: first centroid -> bits of the second ones."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, reached, got, out = [(a[0] + b[0], 0, 0)], [0] * len(o1), 0, {}
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        ci, cj = o1[i], o2[j]
        if n := int(count[ci, cj]):
            got += n
            out[ci] = out.get(ci, 0) | (1 << cj)
        if i + 1 < len(o1) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(o2) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``queries`` holds, its k nearest entries found.

    Every usable row is an entry of every query but its own id's. Nearest first, ties to the smaller id; all entries if
    there are fewer than k. Vectors that are null, zero, of another length than the most common one, or with null or non-finite components take no
    part, nor do null ids. Repeated rows count once. The codebooks are fitted on FIT_SAMPLE rows (least hash of the
    id); every row is indexed. Queries meet entries in blocks of bounded size, however full a cell is. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    make_importable(spark)
    out_schema = "query_id long, rank int, vec_id long, score double"
    v = F.col(vector_col)
    good = vectors.filter(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    good = good.filter(F.size("v") == sizes.d).dropDuplicates(["vec_id", "v"])
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_SAMPLE).select("v").toPandas()["v"]
    books = spark.sparkContext.broadcast(fit_codebooks(np.stack(sample.to_numpy())))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                one, two = (distances(h, book).argmin(axis=1) for h, book in zip(halves(x / np.linalg.norm(x, axis=1, keepdims=True)), books.value, strict=True))
                yield b.assign(one=one.astype("int32"), two=two.astype("int32"))

    entries = good.mapInPandas(index, "vec_id long, v array<double>, asks boolean, one int, two int")
    filled = entries.groupBy("one", "two").count().toPandas()
    count = np.zeros((len(books.value[0]), len(books.value[1])), dtype=np.int64)
    count[filled["one"], filled["two"]] = filled["count"]
    total, asking = int(count.sum()), good.filter("asks").count()
    want, counts = min(total, max(share * total, least, 4 * (k + 1))), spark.sparkContext.broadcast(count)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, x in zip(b["vec_id"], b["v"], strict=True):
                x = np.asarray(x)[None]
                d1, d2 = (distances(h, book)[0] for h, book in zip(halves(x / np.linalg.norm(x)), books.value, strict=True))
                rows += [(i, x[0], one, bits - (1 << 64) * (bits >> 63)) for one, bits in walk(d1, d2, counts.value, want).items()]
            yield pd.DataFrame(rows, columns=["query_id", "q", "one", "bits"])

    def rank(key: tuple, asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(listed):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        q, e = np.stack(asked["q"].to_numpy()), np.stack(listed["v"].to_numpy())
        qn, en = np.sqrt((q * q).sum(axis=1)), np.sqrt((e * e).sum(axis=1))
        own, ids, two = asked["query_id"].to_numpy(), listed["vec_id"].to_numpy(), listed["two"].to_numpy()
        bits = asked["bits"].to_numpy(dtype=np.int64)
        score, best = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for cell in np.unique(two):
            at = np.flatnonzero(two == cell)
            rows = np.flatnonzero((bits >> np.int64(cell)) & 1)
            for low in range(0, len(at), 2_000):
                part = at[low : low + 2_000]
                s = np.einsum("qd,ed->qe", q[rows], e[part]) / (qn[rows, None] * en[part])
                s[own[rows, None] == ids[part]] = -np.inf
                s, n = np.hstack([score[rows], s]), np.hstack([best[rows], np.broadcast_to(ids[part], s.shape)])
                first = np.lexsort((n, -s), axis=1)[:, :k]
                score[rows], best[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(n, first, 1)
        r, c = np.nonzero(np.isfinite(score))
        return pd.DataFrame({"query_id": own[r], "vec_id": best[r, c], "score": score[r, c]})

    per_one = count.sum(axis=1)
    split = F.array(*[F.lit(max(1, -(-int(n) // ENTRY_BLOCK))) for n in per_one])
    blocks = max(1, -(-asking // QUERY_BLOCK))
    parts = F.element_at(split, F.col("one") + 1)
    asked = good.filter("asks").select("vec_id", "v").mapInPandas(probe, "query_id long, q array<double>, one int, bits long")
    asked = asked.select("query_id", "q", "one", "bits", F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long")).alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    listed = entries.select("vec_id", "v", "one", "two", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = asked.groupBy("one", "part", "block").cogroup(listed.groupBy("one", "part", "block")).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of every vector whose id is divisible by 50, among all others. Odd rows as in nearest."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
