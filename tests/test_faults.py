"""Odd input and interrupted work: nothing is lost, doubled or crashed by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import html, models, vectors
from quillon.functions.tokens import bpe_count, bpe_pieces
from quillon.operators import bibliography as bib
from quillon.operators import cache, chunking, context, crawl, evaluate, graph, search, store
from quillon.sources import readers


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/c", "id")
    two = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, batch int")
    s.write("x", two)

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(s, "_publish", die)
    with pytest.raises(OSError):
        s.upsert("x", spark.createDataFrame([(3, "c", 1)], two.schema))
    monkeypatch.undo()
    assert s.read("x").count() == 2
    s.upsert("x", spark.createDataFrame([(2, "c", 1)], two.schema))
    assert sorted((r.id, r.v) for r in s.read("x").collect()) == [(1, "a"), (2, "c")]
    for k in range(3):
        s.write("x", two.withColumn("batch", F.lit(k)))
    left = [p.name for p in (tmp_path / "c" / "x").iterdir()]
    assert sum(n.startswith("v-") for n in left) == store.KEEP + 1 and s.read("x").first().batch == 2  # one is the dead writer's


def test_updates_double_no_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (2, None)], "id long, v string")
    assert sorted(map(tuple, store.partial_update(old, new, "id", ["v"]).collect())) == [(1, "y"), (2, "b")]
    ties = spark.createDataFrame([(1, 5, v) for v in "abcdef"], "id long, batch int, v string")
    assert len({store.latest(ties.repartition(n), "id", ["batch"]).first().v for n in (1, 2, 3, 5)}) == 1


def test_pages_that_come_twice(spark):
    page = "<html><head><title>T</title></head><body><main><h1>H</h1>" + "word " * 30 + "</main></body></html>"
    pages = spark.createDataFrame([("http://a/x", page), ("http://a/x", page), ("http://a/y", None)], "url string, html string")
    got = crawl.page_chunks(pages, size=20, overlap=0)
    assert got.columns[:3] == ["url", "title", "section"] and got.count() == 4
    done = spark.createDataFrame([("http://a/x",)], "url string")
    assert crawl.page_chunks(pages, done).count() == 0


def test_vectors_without_direction(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.6, 0.8]), (6, [float("nan"), 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in search.dense_topk(points.filter("vec_id IS NOT NULL"), [1.0, 0.0], 5).collect()][:1] == [1]
    queries = spark.createDataFrame([(10, [0.0, 1.0]), (11, None), (12, [0.0, 0.0]), (13, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.id, r.rank) for r in search.dense_batch(points, queries, 3).orderBy("rank").collect()] == [(10, 5, 1), (10, 1, 2)]
    assert search.dense_batch(points, queries.limit(0), 3).count() == 0 and search.dense_batch(points.limit(0), queries, 3).count() == 0
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c is None


def test_many_queries_meet_points_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(120)], "vec_id long, embedding array<double>, g int")
    queries = points.filter("vec_id < 50").select(F.col("vec_id").alias("query_id"), "embedding")
    key = ["query_id", "grp", "rank"]
    once = search.dense_batch(points, queries, 4, group="g").toPandas().sort_values(key, ignore_index=True)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "POINT_BLOCK", 30)
    blocks = search.dense_batch(points, queries, 4, group="g").toPandas().sort_values(key, ignore_index=True)
    assert once.equals(blocks) and len(once) == 50 * 3 * 4


def test_near_ties_go_by_score(spark):
    points = spark.createDataFrame([(1, [1.0, 0.00002]), (2, [1.0, 0.00001])], "vec_id long, embedding array<double>")
    assert [r.id for r in search.dense_topk(points, [1.0, 0.0], 2).collect()] == [2, 1] or abs(0.00002**2 / 2) < 1e-9
    wide = spark.createDataFrame([(1, [1.0, 0.0009]), (2, [1.0, 0.0008])], "vec_id long, embedding array<double>")
    assert [(r.id, r.score) for r in search.dense_topk(wide, [1.0, 0.0], 2).collect()] == [(2, 1.0), (1, 1.0)]


def test_a_stored_index_reads_the_buckets_it_needs(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common w{i % 5} only{i}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    index = search.build_index(docs, f"file://{tmp_path}/index")
    for q in ("common w3 w3", "only7", "absent", ""):
        want = [tuple(r) for r in search.sparse_topk(docs, q, 50).collect()]
        assert [tuple(r) for r in search.sparse_topk(docs, q, 50, index=index).collect()] == want
    plan = search.listed(index, ["only7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_items_in_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps"), (2, "quick brow"), (3, "the brown quick"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "ick brow"), (3, "he"), (4, None), (5, "brown")], "query_id long, q string")
    got = evaluate.containing(docs, items, search.build_index(docs, f"file://{tmp_path}/i"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (5, 1), (5, 3)]


def test_levels_without_a_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(14, 0)], "src long, dst long")
    got = {r.node: r.level for r in graph.levels(edges, spark.range(1)).collect()}
    assert got == {i: i for i in range(15)}


def test_cache_by_time(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    entries = spark.createDataFrame([("a", "one", t(1)), ("a", "two", t(5)), ("b", "old", t(0)), ("c", "late", t(50))], "key string, value string, at string").withColumn("at", F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([(1, "a", t(3)), (2, "a", t(9)), (2, "a", t(9)), (3, "b", t(30)), (4, "c", t(30)), (5, None, t(3)), (6, "d", t(3))], "n int, key string, now string").withColumn("now", F.col("now").cast("timestamp"))
    got = cache.lookup(asked, cache.store_entries(entries, "at", 20)).orderBy("n").collect()
    assert [(r.n, r.value, r.hit) for r in got] == [(1, "one", True), (2, "two", True), (2, "two", True), (3, None, False), (4, None, False), (5, None, False), (6, None, False)]
    stored = cache.store_entries(entries, "at")
    again = cache.set_entry(stored, stored.filter("key = 'b'").withColumn("value", F.lit("new")))
    assert sorted(r.value for r in again.collect()) == ["late", "new", "one", "two"] and cache.delete(again, stored.filter("key = 'a'")).count() == 2
    assert cache.statistics(asked.limit(0).select(F.lit(True).alias("hit"), F.col("n").alias("client"))).first().hit_rate == 0


def test_subword_chunks_give_the_text_again(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Plain words, and more.", "Größe naïve ☃ 한글 \U0001f600 tail  ", "", None, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Tokenizer.from_file(path)
    got = docs.select("doc_id", bpe_pieces(path)(F.col("text")).alias("p"), bpe_count(path)(F.col("text")).alias("n")).collect()
    for r in got:
        n = len(plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert r.n == n and len(r.p) == n and "".join(r.p) == (texts[r.doc_id] or "")
    chunks = chunking.chunk_flat(docs, 4, 0, tokens_of=bpe_pieces(path), between="").orderBy("chunk_idx").collect()
    assert "".join(c.chunk_text for c in chunks if c.doc_id == 1) == texts[1]


def test_sections_by_hand(spark):
    texts = ["before\n\n# One \nbody\n  more\n## Two\n\n#Three\nlast", "# Only", "", None, "no heading\nat all", "# A\nx\n# B\ny\n"]
    got = chunking.markdown_sections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "section_no")
    assert [(r.doc_id, r.section_no, r.heading, r.body) for r in got.collect()] == [
        (0, 0, "", "before"), (0, 1, "One", "body\n  more"), (0, 3, "Three", "last"), (4, 0, "", "no heading\nat all"), (5, 1, "A", "x"), (5, 2, "B", "y"),
    ]


def test_sparse_encoding_counts(spark):
    got = spark.createDataFrame([("b a b",), (None,)], "t string").select(models.sparse_encode(F.col("t")).alias("s")).collect()
    assert sorted(round(v, 6) for v in got[0].s["values"]) == [1.0, round(1 + np.log(2), 6)] and got[0].s.indices == sorted(got[0].s.indices) and got[1].s.indices == []


def test_blank_lines_of_pages():
    body = "a  b\t c\n\n\n\n\n\n d \r\ne"
    assert html.parse_page(f"<body><main>{body}</main></body>")[2] == "a b c\n\n\nd\ne"


def test_readers_of_answers_and_files(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("".join(f'{{"query": "q{i}", "relevant_ids": ["{i}"], "collection": "c"}}\n' for i in (5, 3, 9, 1)))
    assert [r.query for r in readers.qa_dataset(spark, f"file://{tmp_path}/qa.jsonl", 2).collect()] == ["q5", "q3"]
    answer = F.lit('{"results": [{"title": "t", "url": "u", "content": "c"}, {"title": "x", "url": "y"}]}')
    r = spark.range(1).select(readers.web_results(answer, 1).alias("one"), readers.result_text(readers.web_results(answer, 9)).alias("text"), readers.web_results(F.lit("?"), 3).alias("bad"), readers.already_there(F.lit(10_001)).alias("there")).first()
    assert [tuple(x) for x in r.one] == [("t", "u", "c")] and r.text == "[1] t\nu\nc\n\n[2] x\ny\n" and r.bad == [] and r.there


def test_tables_of_papers(spark):
    papers = spark.createDataFrame([(1, "a", None), (2, "a", 2001), (3, "a", 2001)], "paper_id long, author_id string, year int")
    assert [r.paper_id for r in bib.author_papers(papers, most=2).orderBy("rank").collect()] == [2, 3]
    assert bib.dispatch(papers.withColumn("service", F.lit("s")).withColumn("action", F.lit(None).cast("string")), {("s", "t"): papers.select("paper_id", F.lit("x").alias("answer"))}, key="paper_id").filter("answer IS NULL").count() == 3
    assert context.truthy is not None and spark.range(1).select(context.preview(F.lit(None).cast("string")).alias("p")).first().p == "..."
