"""Retrieval metrics over (query_id, doc_id, rank) and (query_id, doc_id) relevance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import make_importable
from .search import Index, bucket_of, few


def judged(results: DataFrame, relevant: DataFrame, modes: Sequence[str] | None = None) -> DataFrame:
    """[mode,] query_id, hits (sorted relevant ranks), n_rel: one row for each query with relevance, retrieved or not; with ``modes`` one for each
    of them too, by the results' column mode."""
    by = ["mode", "query_id"] if modes else ["query_id"]
    want = relevant.distinct()
    hit = results.join(want, ["query_id", "doc_id"]).groupBy(*by).agg(F.array_sort(F.collect_set("rank")).alias("hits"))
    n = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    if modes:
        n = n.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return n.join(hit, by, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))


def containing(docs: DataFrame, items: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id: documents whose text has an item's text (query_id, q) in it. Inner words of an item are whole words of such a
    document, so the longest one's postings are the candidates. Items without inner words are looked for in all documents.
    Where the index isn't there yet and items are few, these go to all tasks and each text is read once."""
    inner = F.expr("slice(w, 2, greatest(0, size(w) - 2))")
    keyed = items.select("query_id", "q", words(F.col("q")).alias("w")).select("query_id", "q", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("term"))
    if callable(index) and few(items):
        return _containing_scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keyed).withColumnRenamed("id", id_col)
    index = index() if callable(index) else index
    long = keyed.filter(F.col("term").isNotNull()).withColumn("bucket", bucket_of(F.col("term")))
    maybe = index.join(long, ["bucket", "term"]).select("query_id", "q", F.col("id").alias(id_col))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = texts.join(maybe, id_col).filter(F.contains("__text", F.col("q"))).select("query_id", id_col)
    short = keyed.filter(F.col("term").isNull() & F.col("q").isNotNull())
    if not short.isEmpty():
        found = found.unionByName(texts.join(short, F.contains("__text", F.col("q"))).select("query_id", id_col))
    return found


def _containing_scan(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    make_importable(spark)
    q_type, id_type = keyed.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    by_term: dict[bytes | None, list] = {}
    for r in keyed.filter(F.col("q").isNotNull()).select("query_id", "q", "term").collect():
        by_term.setdefault(None if r.term is None else r.term.encode(), []).append((r.query_id, r.q))
    always = by_term.pop(None, [])
    shared = spark.sparkContext.broadcast((by_term, always))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_term, always = shared.value
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"], strict=True):
                for t in by_term.keys() & set(text.encode().split()):
                    out += [(n, i) for n, q in by_term[t] if q in text]
                out += [(n, i) for n, q in always if q in text]
            yield pd.DataFrame(out, columns=["query_id", "id"])

    return docs.filter(F.col("text").isNotNull() & F.col("id").isNotNull()).mapInPandas(found, f"query_id {q_type}, id {id_type}")


def any_hit(k: int) -> Column:
    """Whether anything relevant is among the first k."""
    return F.exists("hits", lambda r: r <= k)


def recall_at(k: int) -> Column:
    """1 if anything relevant is among the first k: a hit rate."""
    return F.exists("hits", lambda r: r <= k).cast("double")


def reciprocal_rank() -> Column:
    return F.coalesce(1.0 / F.try_element_at("hits", F.lit(1)), F.lit(0.0))


def _gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r.cast("double") + 1.0))


def ndcg_at(k: int) -> Column:
    """To any number of places."""
    ideal = _gain(F.sequence(F.lit(1), F.least(F.col("n_rel").cast("int"), F.lit(k))))
    return _gain(F.filter("hits", lambda r: r <= k)) / ideal


def per_query(j: DataFrame, ks: Sequence[int] = (1, 5, 10), places: int = 6, keep: Sequence[str | Column] = ()) -> DataFrame:
    """The metrics of each query, rounded; for means take as many places as doubles have, so that roundings don't add up."""
    out = [recall_at(k).alias(f"recall_{k}") for k in ks] + [F.round(reciprocal_rank(), places).alias("rr")] + [F.round(ndcg_at(k), places).alias(f"ndcg_{k}") for k in ks]
    return j.select(*keep, "query_id", *out)


def mean_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted means over queries, failed ones included."""
    names = [c for c in rows.columns if c not in (*by, "query_id")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


# What a judge grades an answer by.
JUDGED = ["faithfulness", "answer_relevancy", "context_precision"]


def judged_means(rows: DataFrame) -> DataFrame:
    """n_queries and the means of the judge's grades, to six places; a missing grade isn't counted."""
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in JUDGED])


def p95(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The element at 0-based place int(0.95 n) of the ascending values: found by rank from counts of equal values, so no
    list of all values is gathered."""
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    place = F.floor(0.95 * F.col("n"))
    return placed.filter(F.col("upto") > F.least(place, F.col("n") - 1)).groupBy(*by).agg(F.min(value).alias("p95"), F.max("n").alias("n"))
