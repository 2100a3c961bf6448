"""Pruned sparse search against the search over all postings."""

import random

import pytest

from quillon.operators import blocks, search


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 5, 8, 40, 200])))) for i in range(3_000)]
    docs += [(5_000 + i, docs[7][1]) for i in range(40)] + [(9_000, ""), (9_001, None)]  # ties, and texts without terms
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = tmp_path_factory.mktemp("index")
    index = search.build_index(df, f"file://{path}/postings")
    return index, blocks.build_blocks(index, f"file://{path}/blocks", 50)


@pytest.mark.parametrize("k", [1, 10, 5_000])
def test_same_rows_and_fewer_postings(spark, corpus, k):
    index, lists = corpus
    asked = [(1, "t0 t1"), (2, "t5 t5 t40"), (3, "t59"), (4, "none of these"), (5, ""), (6, None), (7, " ".join(f"t{i}" for i in range(60))), (7, " ".join(f"t{i}" for i in range(60)))]
    queries = spark.createDataFrame(asked[:-1], "query_id long, q string")
    got, told = blocks.pruned_topk(lists, queries, k, first=2)
    want = search.shown(search.rank_by(search.sparse_batch(index, queries), "score", "id", ["query_id"]).filter(f"rank <= {k}"))
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))
    seen = {r.query_id: r for r in told.collect()}
    assert set(seen) == {1, 2, 3, 7} and all(r.scored <= r.postings for r in seen.values())
    every = index.join(blocks.asked_terms(queries), ["bucket", "term"]).groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in every.collect()} == {q: r.postings for q, r in seen.items()}
    if k == 10:
        assert sum(r.scored for r in seen.values()) < sum(r.postings for r in seen.values()) * 0.8
        assert all(r.blocks_scored < r.blocks for q, r in seen.items() if q in (1, 7))


def test_without_queries_or_documents(spark, corpus, tmp_path):
    none = spark.createDataFrame([], "query_id long, q string")
    got, told = blocks.pruned_topk(corpus[1], none, 5)
    assert got.collect() == [] and told.collect() == []
    empty = blocks.build_blocks(search.build_index(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/a"), f"file://{tmp_path}/b")
    got, told = blocks.pruned_topk(empty, spark.createDataFrame([(1, "t0")], "query_id long, q string"), 5)
    assert got.collect() == [] and told.collect() == []
