"""Compression of vectors to codes of integer codebooks.

A vector's components become integers and its equal parts are each replaced by the number of the nearest entry in the part's codebook. Arrow batches
measure all distances at once by norm expansion, |x|^2 - 2xb + |b|^2, in exact 64-bit integer products; each task adds up the parts
of every entry, and a grouped shuffle merges these sums. The codebooks alone pass through the driver; their size is fixed by parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, look_up, make_importable, settle, table

#: Parts of a vector, entries of a codebook, rounds of fitting, integers to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


@dataclass
class Codebooks:
    """entries: parts x entries x components of a part, integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def parts_of(self, vectors: pa.Array) -> np.ndarray:
        """rows x parts x components of Arrow lists, as integers rounded down."""
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return np.floor(flat * self.scale).astype(np.int64).reshape(len(vectors), self.entries.shape[0], -1)

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the number of the nearest entry (ties: the first), and the squared distance."""
        book = self.entries[part]
        apart = (book * book).sum(axis=1) - 2 * (x @ book.T)
        first = apart.argmin(axis=1)
        return first, apart[np.arange(len(x)), first] + (x * x).sum(axis=1)


def usable(vectors: DataFrame, vector_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """The rows that have a code, and the length of their vectors (0 if there are none)."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = vectors.filter(v.isNotNull() & fine & (F.size(v) > 0) & (F.size(v) % parts == 0))
    size = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return good, 0
    most = isqrt((1 << 62) // size.d) // 2 // scale
    return good.filter((F.size(v) == size.d) & F.forall(v, lambda x: F.abs(x) < most)), size.d


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks that start as the parts of the ``entries`` smallest ids (null ids last; fewer rows, fewer entries). Each round gives every part to its
    nearest entry and puts the componentwise mean, rounded down, in each entry's place; entries without parts stay. All usable rows count
    in every round. None without usable rows."""
    spark = vectors.sparkSession
    make_importable(spark)
    good, dim = usable(vectors, vector_col, parts, scale)
    rows = good.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    if not first:
        return None
    whole = np.floor(np.array([r.v for r in first], dtype=np.float64) * scale).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(whole.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total, n = np.zeros_like(own.entries), np.zeros(own.entries.shape[:2], dtype=np.int64)
            for b in batches:
                x = own.parts_of(b.column(0))
                for p in range(len(total)):
                    at, _ = own.nearest(p, x[:, p])
                    np.add.at(total[p], at, x[:, p])
                    n[p] += np.bincount(at, minlength=n.shape[1])
            p, e = np.nonzero(n)
            width = total.shape[2]
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(p, width).astype(np.int32), "entry": np.repeat(e, width).astype(np.int32), "place": np.tile(np.arange(width, dtype=np.int32), len(p)),
                "total": total[p, e].ravel(), "n": np.repeat(n[p, e], width),
            })

        told = rows.select("v").mapInArrow(sums, "part int, entry int, place int, total long, n long")
        merged = told.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        entries_now = books.entries.copy()
        entries_now[merged["part"], merged["entry"], merged["place"]] = merged["total"].to_numpy() // merged["n"].to_numpy()
        books = Codebooks(entries_now, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The ``keep`` columns, code (the nearest entries' numbers from 0 in order of parts, each in two or more hex digits) and error (squared
    distances, summed over parts) of the vectors that the codebooks fit; others are left out. No shuffle."""
    spark = vectors.sparkSession
    make_importable(spark)
    good, dim = usable(vectors, vector_col, len(books.entries), books.scale)
    v = F.col(f"`{vector_col}`")
    rows = good.filter(F.lit(dim == books.dim)).select(*[F.col(f"`{c}`") for c in keep], v.alias("__v"))
    shared, digits = spark.sparkContext.broadcast(books), max(2, len(f"{books.entries.shape[1] - 1:x}"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        hexes = np.array([f"{i:0{digits}x}" for i in range(own.entries.shape[1])], dtype=object)
        for b in batches:
            x = own.parts_of(b.column(b.num_columns - 1))
            text, error = np.full(len(x), "", dtype=object), np.zeros(len(x), dtype=np.int64)
            for p in range(x.shape[1]):
                at, d = own.nearest(p, x[:, p])
                text, error = text + hexes[at], error + d
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array(error)], [*keep, "code", "error"])

    return rows.mapInArrow(code, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", code string, error long")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """codes and ``vector``: what the entries stand for, the middle of each component's step. A code that is null, or none of these codebooks', gives null; an
    input column named vector gives way."""
    spark = codes.sparkSession
    make_importable(spark)
    shared, digits = spark.sparkContext.broadcast(books), max(2, len(f"{books.entries.shape[1] - 1:x}"))

    @F.pandas_udf("array<double>")
    def vector(batch):
        own = shared.value
        middle = (own.entries + 0.5) / own.scale

        def one(c):
            try:
                at = [int(c[k : k + digits], 16) for k in range(0, len(c), digits)]
                return np.concatenate([middle[p, i] for p, i in enumerate(at)]) if len(c) == digits * len(middle) else None
            except (TypeError, ValueError, IndexError):
                return None

        return batch.map(one)

    kept = [F.col(f"`{c}`") for c in codes.columns if c.lower() != "vector"]
    return codes.select(*kept, vector(F.col(f"`{code_col}`")).alias("vector"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **fit) -> DataFrame:
    """id, label, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256, one row per usable row.

    Left out are vectors that are null or empty, hold null or non-finite components, have another length than the commonest (of those that ``parts``
    divides), or components so large that squared distances don't fit 64 bits (131,072 and more in vectors of 64). Repeated rows and null ids
    stay; other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"`{id_col}` {kinds[id_col]}, `{label_col}` {kinds[label_col]}, code string, error long, label_error long, codebooks_sha256 string"
    books = fit_codebooks(vectors, id_col, vector_col, **fit)
    if books is None:
        return spark.createDataFrame([], schema)
    coded = encode(vectors, books, vector_col, (id_col, label_col))
    label = F.when(F.col(f"`{label_col}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")))
    coded = settle(coded.withColumn("__label", label), "vector-codes")
    sums = settle(coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")), "label-errors")
    out = look_up(coded, sums, "__label", "__n", F.xxhash64("code"))
    return out.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by four codebooks of 256 entries, four rounds. Odd rows as in compress."""
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _sql(rounds: int = ROUNDS) -> str:
    apart = "list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, b.entry, {apart} AS d FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, part)"
    parts = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(x, part * (len(x) // {PARTS}) + 1, (part + 1) * (len(x) // {PARTS})) AS y FROM v, range(0, {PARTS}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y FROM p QUALIFY entry < {ENTRIES})",
    ]
    for k in range(rounds):
        down = "(s - ((s % c) + c) % c) // c"
        parts += [
            near(k),
            f"s{k} AS (SELECT part, entry, list({down} ORDER BY pos)::BIGINT[] AS y FROM (SELECT a.part, a.entry, pos, sum(p.y[pos])::BIGINT AS s, count(*) AS c FROM a{k} a JOIN p USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(p.y) + 1)) AS pos) GROUP BY ALL) GROUP BY part, entry)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.y, b.y) AS y FROM b{k} b LEFT JOIN s{k} s USING (part, entry))",
        ]
    parts += [
        near(rounds),
        f"h AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(y, ',') AS t FROM b{rounds}))",
        f"c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"


OP12_SQL = _sql()
