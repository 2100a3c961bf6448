"""Lexical search straight from the texts: the rows of the stored index, which isn't built for few queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, evaluate, search
from quillon.plans import catalog, registry, search_plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(90_001, None), (90_002, " "), (90_003, "a b \x0bde\x1cla "), (90_004, "de la de\nla de"), (90_005, "de la de\nla de")], "doc_id long, text string")
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").unionByName(odd).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    items = spark.read.parquet(f"{D}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return items.unionByName(spark.createDataFrame([(70_001, "de la la"), (70_002, "nowhere-in-any"), (70_003, None), (70_004, "a b de"), (70_005, "")], "query_id long, q string"))


def test_scan_equals_index(spark, docs, items, tmp_path, monkeypatch):
    index = search.build_index(docs, f"file://{tmp_path}/i")
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    cols = ["query_id", "rank", "id", "score"]
    monkeypatch.setattr(search, "TEXT_BLOCK", 7)
    for k in (3, 100):
        assert rows(search.lexical(docs, items, k, lambda: 1 / 0), *cols) == rows(search.lexical(docs, items, k, index), *cols)
    grouped = docs.withColumn("collection", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    members = grouped.select(F.explode("collection").alias("collection"), F.col("doc_id").alias("id"))
    want = search.shown(search.rank_by(search.sparse_batch(index, items).join(members, "id"), "score", "id", ["query_id", "collection"]).filter("rank <= 4"))
    assert rows(search.sparse_scan(grouped, items, 4, group="collection"), "grp", *cols) == rows(want, "collection", *cols)
    assert rows(evaluate.containing(docs, items.filter("q <> ''"), lambda: 1 / 0), "query_id", "doc_id") == rows(evaluate.containing(docs, items.filter("q <> ''"), index), "query_id", "doc_id")
    assert search.lexical(docs.limit(0), items, 3, lambda: 1 / 0).count() == search.lexical(docs, items.limit(0), 3, lambda: 1 / 0).count() == 0


def test_texts_of_one_id_count_as_one(spark, items):
    twice = spark.createDataFrame([(1, "de la"), (1, "de"), (2, "de de x"), (None, "la")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "de la de"), (2, "de de x"), (None, "la")], "doc_id long, text string")
    asked, index = items.filter("query_id = 70001"), search.postings(one).withColumn("bucket", search.bucket_of(F.col("term")))
    got = search.lexical(twice, asked, 5, lambda: search.postings(twice).withColumn("bucket", search.bucket_of(F.col("term")))).collect()
    assert got == search.shown(search.rank_by(search.sparse_batch(index, asked), "score", "id", ["query_id"])).collect() and len(got) == 3


@pytest.mark.parametrize("name", ["eval_mrr", "sparse_topk_batch", "filtered_hybrid", "rerank_topn", "sparse_topk", "eval_ndcg", "chat_graph", "chat_answers", "eval_recall", "eval_by_mode", "multi_collection_hybrid", "filtered_hybrid_batch", "sources_footnotes", "context_blocks"])
def test_few_queries_build_no_index(spark, monkeypatch, name):
    monkeypatch.setattr(search_plans, "stored_index", lambda *a: 1 / 0)
    assert registry.QUERIES[name](spark, D).limit(1).count() == 1


def test_dense_batch_holds_few_scores_at_once(spark, monkeypatch):
    points = [(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0 + i % 3]) for i in range(600)]  # 105 different vectors, so many ties
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(2)
    top = lambda: sorted(tuple(r) for r in search.dense_batch(df, df.filter("vec_id % 20 = 0"), 4, q_id="vec_id").drop("grp").collect())

    x = np.array([v for _, v in points])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    want = sorted((q, i, round(s[q, i], 6), r + 1) for q in range(0, 600, 20) for r, i in enumerate(np.lexsort((np.arange(600), -s[q]))[:4].tolist()))
    monkeypatch.setattr(search, "SCORES", 30 * 40)  # 30 queries meet 40 points at once
    for few in (search.QUERY_BLOCK, 16):
        monkeypatch.setattr(search, "QUERY_BLOCK", few)
        assert [r[:2] + (round(r[2], 6), r[3]) for r in top()] == want


def test_blocks_of_texts(spark, docs, items, tmp_path, monkeypatch):
    index = search.build_index(docs, f"file://{tmp_path}/i")
    lists = blocks.blocks_of_texts(docs, f"file://{tmp_path}/b", per_block=16)
    got, told = blocks.pruned_topk(lists, items, 5, first=2)
    want = search.lexical(docs, items, 5, index)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    assert rows(got) == rows(want)
    every = index.join(blocks.asked_terms(items), ["bucket", "term"]).groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in every.collect()} == {r.query_id: r.postings for r in told.collect()}
    monkeypatch.setattr(registry, "stored_index", lambda *a: 1 / 0)
    registry._BLOCKS.clear()
    assert registry.stored_blocks(spark, D).lists.count() > 0
    registry._BLOCKS.clear()
    assert blocks.blocks_of_texts(docs.limit(0), f"file://{tmp_path}/e").lists.count() == 0


def test_passages_rank_and_cut_by_nine_places(spark, tmp_path):
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(0, [1.0, 0.0]), (1, at(0.5)), (2, at(0.5 + 2e-7)), (3, at(0.25 - 2e-7)), (4, at(0.25 + 2e-7))]  # alike in six places
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalog.QUERIES["tool_passages"](spark, str(tmp_path)).orderBy("rank").collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(catalog.ORACLE_SQL["tool_passages"] + " ORDER BY rank").fetchall()
    assert got == want == [(0, 0, 1), (0, 2, 2), (0, 1, 3), (0, 4, 4)]


@pytest.mark.parametrize("few", [search.QUERY_BLOCK, 16])
def test_every_paper_is_recommended_others(spark, tmp_path, monkeypatch, few):
    rng = np.random.default_rng(3)
    rows = [(i % 90, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(100)]  # many ties, and ten ids with two vectors
    spark.createDataFrame([(i, v) for i, v in rows if any(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(search, "QUERY_BLOCK", few)
    monkeypatch.setattr(search, "POINT_BLOCK", 40)
    monkeypatch.setattr(search, "SCORES", 300)
    got = [tuple(r) for r in catalog.QUERIES["tool_recommended"](spark, str(tmp_path)).orderBy("paper_id", "rank").collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(catalog.ORACLE_SQL["tool_recommended"] + " ORDER BY paper_id, rank").fetchall()
    assert got == want and len({p for p, _, _ in got}) == len({i for i, v in rows if any(v)})
