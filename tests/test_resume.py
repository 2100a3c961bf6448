"""Work that is killed and run again; traces, sketches and progress."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quillon.operators import crawl, graph, tracing
from quillon.streaming.sessions import Progress, sessions


def test_levels_go_on_after_the_last_complete_one(spark, tmp_path):
    rng = random.Random(0)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(None, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    want = {r.node: r.level for r in graph.levels(edges, seeds).collect()}
    path = f"file://{tmp_path}/l"
    graph.levels(edges, seeds, 2, path=path)
    kept = (tmp_path / "l/level=1").stat().st_mtime_ns
    shutil.rmtree(tmp_path / "l/level=2")  # killed while it wrote level 2
    (tmp_path / "l/level=2").mkdir()
    got = graph.levels(edges, seeds, path=path)
    assert {r.node: r.level for r in got.collect()} == want and got.count() == len(want)
    assert (tmp_path / "l/level=1").stat().st_mtime_ns == kept
    assert graph.levels(edges, seeds.limit(0)).count() == 0


def test_expansion_goes_on_and_stops_where_nothing_is_downloaded(spark, tmp_path):
    refs = [(1, 2, 5, True), (1, 3, 9, False), (1, 4, 9, True), (1, 4, 9, True), (2, 5, 1, True), (4, 1, 1, True), (4, 6, 2, True), (5, 7, None, None), (6, 8, 1, True), (3, 9, 1, True), (1, 1, 99, True)]
    r = spark.createDataFrame(refs, "src long, dst long, citation_count int, downloaded boolean")
    papers = spark.createDataFrame([(1,)], "paper long")
    rows = lambda df: sorted((x.level, x.source, x.node, x["rank"]) for x in df.collect())
    want = [(1, 1, 2, 3), (1, 1, 3, 1), (1, 1, 4, 2), (2, 2, 5, 1), (2, 4, 1, 2), (2, 4, 6, 1), (3, 5, 7, 1), (3, 6, 8, 1)]
    whole = graph.expand(papers, r, f"file://{tmp_path}/a")
    assert rows(whole) == want
    graph.expand(papers, r, f"file://{tmp_path}/b", 1)
    assert rows(graph.expand(papers, r, f"file://{tmp_path}/b", 3)) == want
    assert rows(graph.expand(papers, r, f"file://{tmp_path}/c", 3, json_only=True)) == want[:6]
    assert graph.expand(papers, r, f"file://{tmp_path}/d", 0).count() == 0
    assert rows(graph.expand(papers, r, f"file://{tmp_path}/e", 1, most=1)) == [(1, 1, 3, 1)]


def test_sites_are_crawled_apart(spark):
    page = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = spark.createDataFrame(
        [("https://a.org/d/i", page("x", "/other", "https://b.org/d/q", "y#top")), ("https://a.org/d/x", page("z")), ("https://a.org/d/y", page("x.pdf")), ("https://b.org/", page("p")), ("https://a.org/d/z", None)], "url string, html string"
    )
    seeds = spark.createDataFrame([("https://a.org/d/i#s",), ("https://b.org/",), (None,)], "seed string")
    extra = spark.createDataFrame([("https://b.org/", "https://b.org/m#1"), ("https://b.org/", "https://c.org/m"), ("https://z.org/", "https://z.org/m")], "seed string, url string")
    got = {(r.seed[8], r.url, r.level) for r in crawl.crawl_sites(pages, seeds, -1, extra).collect()}
    a, b = "https://a.org/d/", "https://b.org/"
    assert got == {("a", a + "i", 0), ("a", a + "x", 1), ("a", a + "y", 1), ("a", a + "z", 2), ("b", b, 0), ("b", b + "m", 0), ("b", b + "p", 1)}


AT = dt.datetime(2024, 1, 1, 12)


def test_traces(spark, tmp_path):
    requests = spark.createDataFrame([(1, "q1", ["c"], AT, 7), (2, "q2", None, AT, None)], "trace_id long, query string, collections array<string>, at timestamp, num_candidates int")
    hits = spark.createDataFrame([(1, f"d{k}", "c", k, 0.12345 * k, "t" * 100) for k in range(1, 8)], "trace_id long, id string, collection string, rank int, score double, title string")
    web = spark.createDataFrame([(1, k, f"u{k}") for k in range(1, 5)], "trace_id long, rank int, url string")
    answers = spark.createDataFrame([(1, "q1", "ctx", "r" * 600, "m", 10, None, AT), (2, "q2", "ctx", None, "m", None, None, AT)], "trace_id long, query string, context string, response string, model string, prompt_tokens long, completion_tokens long, at timestamp")
    log = tracing.together(tracing.retrieval(requests, hits), tracing.reranking(requests, hits), tracing.web_search(requests, web), tracing.generation(answers), tracing.cache_hits(requests.filter("trace_id = 2").withColumn("key", F.lit("k"))))
    tracing.write(log, None)
    tracing.write(log, f"file://{tmp_path}/log")
    stored = spark.read.parquet(f"file://{tmp_path}/log")
    assert stored.count() == 9 and stored.filter("day = '2024-01-01'").count() == 9
    one = {(r.trace_id, r.name): (r.input, r.output) for r in stored.collect()}
    assert one[1, "retrieval"] == ('{"query":"q1","collections":["c"],"num_collections":1}', '{"num_candidates":7,"top_ids":["d1","d2","d3","d4","d5"],"collections_searched":["c"]}')
    assert one[2, "retrieval"][1] == '{"num_candidates":0,"top_ids":[],"collections_searched":[]}'
    assert '"top_scores":[0.1235,0.2469,0.3704,0.4938,0.6173]' in one[1, "reranking"][1] and one[2, "reranking"][1] == '{"num_reranked":0,"top_scores":[],"top_titles":[]}'
    assert one[1, "web_search"][1] == '{"num_results":4,"urls":["u1","u2","u3"]}'
    assert one[1, "generation"][1] == '{"response":"' + "r" * 500 + '","prompt_tokens":10}'
    failures = spark.createDataFrame([(2, "b"), (2, "a")], "trace_id long, error string")
    got = {r.trace_id: r for r in tracing.summary(stored, failures).collect()}
    assert (got[1].num_spans, got[1].events, got[1].tokens, got[1].success, got[1].error) == (4, 0, 10, True, None)
    assert (got[2].num_spans, got[2].events, got[2].tokens, got[2].success, got[2].error) == (4, 1, 0, False, "a")
    assert tracing.summary(stored).filter("success").count() == 2


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties"])
def test_merged_sketches_are_near(spark, kind):
    rng = random.Random(7)
    draw = {"uniform": lambda: rng.random(), "heavy": lambda: rng.paretovariate(0.7), "ties": lambda: float(rng.randrange(5))}[kind]
    rows = [(d, m, draw()) for d in range(12) for m in "ab" for _ in range(1_500)] + [(1, "a", None)]
    df = spark.createDataFrame(rows, "day int, mode string, ms double")
    sketches = tracing.quantile_sketches(df, "ms", ["mode", "day"])
    for r in tracing.merged_quantile(sketches, ["mode"], 0.95).collect():
        own = sorted(v for _, m, v in rows if m == r["mode"] and v is not None)
        assert r.n == len(own)
        below, upto = sum(v < r.quantile for v in own) / len(own), sum(v <= r.quantile for v in own) / len(own)
        assert below - 0.02 <= 0.95 <= upto + 0.02


def test_sessions_of_a_table(spark):
    at = lambda m: AT + dt.timedelta(minutes=m)
    rows = [("a", at(0), 5, False), ("a", at(20), None, True), ("a", at(55), 1, None), ("b", at(0), 1, False), (None, at(0), 1, False), ("b", None, 1, False)]
    df = spark.createDataFrame(rows, "trace string, at timestamp, tokens int, failed boolean")
    got = sorted((r.trace, r.began, r.ended, r.spans, r.tokens, r.failures) for r in sessions(df, "trace").collect())
    assert got == [("a", at(0), at(50), 2, 5, 1), ("a", at(55), at(85), 1, 1, 0), ("b", at(0), at(30), 1, 1, 0)]


def test_progress_rows_add_up(spark, tmp_path):
    source, to, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.range(100).repartition(4).write.parquet(source)
    seen = Progress(expected=150)
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if sum(r["rows"] for r in seen.rows) >= 100:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    seen.write(spark, f"file://{tmp_path}/progress")
    rows = spark.read.parquet(f"file://{tmp_path}/progress").orderBy("batch").collect()
    assert sum(r["rows"] for r in rows) == 100 and len([r for r in rows if r["rows"]]) == 4
    assert all(r.rate > 0 for r in rows if r["rows"]) and rows[-1].left == 50 and rows[-1].eta_seconds > 0
