"""Literal cases of the text, HTML, routing, fusion, chunking and evaluation functions."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.html import join_url, parse_page
from quillon.operators import cache, chunking, cluster, context, evaluate, graph, routing, search, store
from quillon.sources import readers, sinks


def one(spark, expr, **cols):
    schema = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()) or "x string"
    return spark.createDataFrame([tuple(cols.values()) or (None,)], schema).select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Functions — Rust Reference", "Functions — Rust Reference"), ("Installation | Docs", "Installation"), ("Overview - Documentation ", "Overview"), ("a\n| wiki", "a")])
def test_clean_title(spark, raw, want):
    assert one(spark, tx.clean_title(F.col("t")), t=raw) == want


def test_url_functions(spark):
    assert one(spark, tx.defragment(F.col("u")), u="https://docs.example.com/foo/#bar") == "https://docs.example.com/foo/"
    assert one(spark, tx.url_authority(F.col("u")), u="http://h:80/p?q") == "h:80"
    assert one(spark, tx.under_seed(F.col("u"), F.lit("https://h/a/index.html")), u="https://h/a/b") is True
    assert one(spark, tx.under_seed(F.col("u"), F.lit("https://h/a/index.html")), u="https://h/b") is False
    assert one(spark, tx.skipped_url(F.col("u")), u="https://h/x.PDF?y") is True
    assert one(spark, tx.old_version(F.col("u"), F.lit("https://h/stable/")), u="https://h/v1.2.3/x") is True
    assert one(spark, tx.old_version(F.col("u"), F.lit("https://h/v1.2.3/")), u="https://h/v1.2.3/x") is False
    assert one(spark, join_url(F.col("b"), F.col("h")), b="https://h/a/b", h="../c") == "https://h/c"


def test_strings(spark):
    assert one(spark, tx.year_of(F.col("d")), d="2021-05-01") == 2021
    assert one(spark, tx.year_of(F.col("d")), d="n.d.") is None
    assert one(spark, tx.pdf_year(F.col("d")), d="D:2019") == 2019
    assert one(spark, tx.paper_ids(F.col("d")), d="see 2101.00001v2, 2101.00001 and 1706.03762.") == ["2101.00001", "1706.03762"]
    assert one(spark, tx.strip_inline_images(F.col("d")), d="a ![x](data:image/png;base64,AAAA) b " + "Q" * 120) == "a [image] b "
    assert one(spark, tx.reference_titles(F.col("d")), d="[1] A title that is surely longer than thirty\n[2] short") == ["A title that is surely longer than thirty"]
    assert one(spark, tx.clean_topic(F.col("d"), F.lit("topic_1")), d='Topic: "Graphs"') == "Graphs"
    assert one(spark, tx.clean_topic(F.col("d"), F.lit("topic_1")), d=None) == "topic_1"
    assert one(spark, tx.limit_blank_lines(F.col("d")), d="a\n\n\n\n\n\nb  c") == "a\n\n\nb c"
    assert one(spark, tx.time_sensitive(F.col("d")), d="A renewal") is True


def test_parser_tier():
    page = '<html><head><title> T | Docs </title></head><body><nav>no</nav><main><h1>Head</h1><p>a  b</p><pre>x\ny</pre><div class="toc big">no</div><aside>no</aside></main><footer>no</footer></body></html>'
    assert parse_page(page) == ("T | Docs", "Head", "Head\na b\n\nx\ny")
    assert parse_page('<body><div id="content">in</div>out</body>')[2] == "in"
    assert parse_page('<article>one</article><div role="main">two</div>')[2] == "two"
    assert parse_page("") == parse_page(None) == ("", "", "")


def test_router_ties_and_fallbacks(spark):
    q = spark.createDataFrame([(1, "deep learning with transformer models"), (2, "   "), (3, None), (4, "zzz")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.collection, r.score) for r in routing.route_queries(q).collect()}
    assert got[1, 1] == ("arxiv-cs-ml-ai", 4.0)
    assert all(got[i, 1] == ("arXiv", 0.0) for i in (2, 3, 4))
    tie = [("b", 0, "second", 1.0, 0), ("a", 1, "first", 1.0, 0)]
    assert [r.collection for r in routing.route_queries(q.filter("query_id = 1").withColumn("query", F.lit("a b")), tie).orderBy("rank").collect()] == ["second", "first"]
    assert routing.route_queries(q.withColumn("query", F.lit("fragment")).limit(1), [("rag", 0, "c", 1.0, 0)], word_bounds=True).first().collection == "arXiv"
    papers = spark.createDataFrame([(1, "cs.LG cs.AI"), (2, "cond-mat.mes-hall"), (3, "unknown.xx hep-th"), (4, None)], "paper_id long, categories string")
    assert [r.collection for r in routing.route_papers(papers).orderBy("paper_id").collect()] == ["arxiv-cs-ml-ai", "arxiv-condmat", "arxiv-hep", "arXiv"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.permutations(range(6)), min_size=1, max_size=3))
def test_fusion_ignores_the_order_of_lists(spark, lists):
    frames = [spark.createDataFrame([(int(i), r) for r, i in enumerate(x, 1)], "id long, rank int") for x in lists]
    a, b = ({r.id: r.score for r in search.rrf(f).collect()} for f in (frames, frames[::-1]))
    assert a == b


def test_dense_search_without_queries_or_points(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert search.dense_batch(points, empty, 3, q_id="vec_id").count() == 0
    assert search.dense_batch(empty, points.limit(1), 3, q_id="vec_id").count() == 0
    assert [r.id for r in search.dense_topk(points, [1.0, 0.1], 5).orderBy("rank").collect()] == [1, 2]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 60), st.integers(1, 12), st.integers(0, 11))
def test_windows_cover_every_token(spark, n, size, overlap):
    overlap = min(overlap, size - 1)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "doc_id long, text string")
    chunks = [list(map(int, r.chunk_text.split())) for r in chunking.chunk_flat(docs, size, overlap).orderBy("chunk_idx").collect()]
    assert sorted({t for c in chunks for t in c}) == list(range(n))
    assert all(a[-overlap:] == b[:overlap] for a, b in zip(chunks, chunks[1:]) if overlap and len(a) == size)


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\n\n# Three\nlast line"), (2, None)], "doc_id long, text string")
    s = chunking.markdown_sections(docs)
    assert [(r.heading, r.body) for r in s.orderBy("section_no").collect()] == [("", "intro"), ("One", "body"), ("Three", "last line")]
    long = chunking.chunk_sections(s.withColumn("body", F.lit("a b c d e")), 3, 1)
    assert [r.chunk_text for r in long.filter("heading = 'One'").orderBy("chunk_idx").collect()] == ["a b c", "One\n\nc d e"]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 12, 2)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 77), (3, 1), (1, 11)], "query_id long, doc_id long")
    m = {r.query_id: r for r in evaluate.per_query(evaluate.judged(found, rel)).collect()}
    assert (m[1].recall_1, m[1].recall_5, m[1].rr) == (0.0, 1.0, 0.5)
    assert m[1].ndcg_5 == round((1 / np.log2(3)) / (1 + 1 / np.log2(3)), 6)
    assert m[2].rr == m[3].rr == 0.0 and 0 <= m[2].ndcg_10 <= 1
    values = spark.createDataFrame([(float(i),) for i in range(40)] + [(None,)], "v double")
    assert evaluate.p95(values, "v").first().p95 == sorted(range(40))[int(0.95 * 40)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, batch int")
    s.create("c")
    assert s.read("c") is None and s.collections() == ["c"]
    s.upsert("c", old)
    for _ in range(2):  # a batch that comes twice changes nothing
        s.upsert("c", spark.createDataFrame([(2, "B", 1), (3, "c", 1)], "id long, v string, batch int"))
    s.update("c", spark.createDataFrame([(1, "A"), (9, "x")], "id long, v string"), ["v"])
    assert [(r.id, r.v) for r in s.read("c").orderBy("id").collect()] == [(1, "A"), (2, "B"), (3, "c")]
    manifest = s.snapshot("c", f"file://{tmp_path}/snap")
    assert manifest.filter("length(sha256) = 64 AND bytes > 0").count() > 0
    s.drop("c")
    assert s.collections() == []
    points = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0])], "collection string, dense_embedding array<float>")
    store.export(points, f"file://{tmp_path}/e", 2)
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {r.node: r.level for r in graph.levels(edges, seeds).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node for r in graph.levels(edges, seeds, 0).collect()} == {1}


def test_context(spark):
    c = F.lit
    text = context.citation(c(1), c("x1"), c("T"), c("A, B"), c(2020), c(""), c("abstract"), c(""), c(None).cast("string"), c("body"))
    assert one(spark, text) == "[1] ArXiv:x1 — T\n  A, B (2020)\n  body"
    web = context.citation(c(2), c(""), c("W"), c(""), c(None).cast("int"), c(""), c("web"), c("http://u"), c("snip"), c(None).cast("string"))
    assert one(spark, web) == "[2] — W\n  Source: http://u\n  snip"
    q = spark.createDataFrame([(7,)], "query_id long")
    assert context.build_context(spark.createDataFrame([], "query_id long, rank int, citation string"), q).first().context == context.NO_CONTEXT
    assert one(spark, context.frames(F.col("t")), t="x" * 45) == ["x" * 20, "x" * 20, "x" * 5]
    assert one(spark, context.rerank_text(c(" "), c("t"), c("a"))) == "t\n\na"
    hit = context.hit_columns(spark.createDataFrame([(5, None)], "point_id long, title string")).first()
    assert (hit.arxiv_id, hit.title, hit.type, hit.year) == ("5", "", "abstract", None)
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.text for r in context.last_user_message(turns).collect()} == {1: "q", 2: "s"}


def test_cache(spark):
    at = datetime.datetime(2024, 1, 1)
    e = cache.store_entries(spark.createDataFrame([("a", 1, at), ("a", 2, at + datetime.timedelta(minutes=5)), ("b", 3, at - datetime.timedelta(hours=2))], "key string, value int, at timestamp"), "at")
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "key string").withColumn("now", F.lit(at + datetime.timedelta(minutes=6)))
    assert {x.key: (x.value, x.hit) for x in cache.lookup(r, e).collect()} == {"a": (2, True), "b": (None, False), "c": (None, False)}
    assert cache.flush(e, "a").count() == 1
    key = lambda q, c: one(spark, cache.cache_key(F.col("q"), F.array(*map(F.lit, c)), F.lit("")), q=q)
    assert key(" Q\n", ["x", "y"]) == key("q", ["y", "x"]) != key("q", ["x"])


def test_readers(spark, tmp_path):
    p = tmp_path / "raw.jsonl"
    p.write_text('{"id": "1", "title": " a\\nb ", "abstract": "x", "update_date": "1999-01-01"}\n\nnot json\n{"arxiv_id": "2", "journal_ref": "J", "update_date": "2020-01-01"}\n{"title": "no id"}\n')
    raw = readers.raw_metadata(spark, f"file://{p}")
    assert {r.arxiv_id for r in raw.collect()} == {"1", "2"}
    n = readers.normalised_papers(raw)
    assert [(r.arxiv_id, r.journal_ref) for r in n.collect()] == [("2", "J")]
    assert readers.normalised_papers(raw, 1990).filter("arxiv_id = '1'").first().title == "a b"
    assert readers.progress(spark, f"file://{tmp_path}/none").count() == 0
    sinks.append_progress(raw.select("arxiv_id"), f"file://{tmp_path}/done")
    assert {r.id for r in readers.progress(spark, f"file://{tmp_path}/done").collect()} == {"1", "2"}
    toml = 'collection = "c"\ntag = "t"\ndepth = 2\n[[targets]]\nurl = "https://a"\ndescription = "d"\n[[targets]]\nurl = "https://b"\n'
    assert [(r.collection, r.depth, r.url) for r in readers.crawl_config(spark, toml).collect()] == [("c", 2, "https://a"), ("c", 2, "https://b")]
    seeds = readers.seed_urls(spark.createDataFrame([(0, " u "), (1, "#x"), (2, ""), (3, "v"), (4, "u")], "pos int, value string"))
    assert [r.url for r in seeds.orderBy("pos").collect()] == ["u", "v"]
    site = spark.createDataFrame([('<urlset xmlns="http://s"><url><loc>https://h/a/1#x</loc></url><url><loc>https://h/a/1</loc></url><url><loc>https://h/a/z.pdf</loc></url><url><loc>https://o/a/1</loc></url></urlset>', "https://h/a/")], "xml string, seed string")
    assert [r.url for r in readers.sitemap_urls(site).collect()] == ["https://h/a/1"]
    m = readers.manifests(spark.createDataFrame([('{"level": 1, "references": [{"title": "t", "downloaded": true, "availability": "none"}]}',), ("{bad",)], "value string"))
    assert graph.manifest_summary(m.filter("level = 1")).first().asDict() == {"level": 1, "n_manifests": 1, "n_references": 1, "downloaded": 1, "ingested": 0, "no_access": 1}
    assert one(spark, readers.parse_scores(F.col("s"), 3), s='[{"index": 2, "score": 0.5}]') == [0.0, 0.0, 0.5]
    assert one(spark, readers.parse_scores(F.col("s"), 2), s="[0.25]") == [0.25, 0.0]
    assert one(spark, readers.file_paper_id(F.col("s")), s="/x/L1_2101.00001v3.pdf") == "2101.00001"
