"""Odd input to search, routing, caching and titles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import bibliography as bib
from quillon.operators import cache, context, routing, search
from quillon.operators.routing_tables import KEYWORDS


def test_a_ragged_query_drops_no_other(spark):
    points = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    asked = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    for order in (asked, asked[::-1]):
        got = search.dense_batch(points, spark.createDataFrame(order, "query_id long, embedding array<double>"), 2)
        assert {r.query_id for r in got.collect()} == {2, 3} and got.count() == 4
    lone = spark.createDataFrame(asked[:1], "query_id long, embedding array<double>")
    assert search.dense_batch(points, lone, 2).count() == 0


def test_a_query_that_comes_twice_is_routed_twice(spark):
    q = spark.createDataFrame([(1, "Deep learning for galaxies"), (1, "Deep learning for galaxies"), (2, None), (None, "quark")], "query_id long, query string")
    got = [tuple(r) for r in routing.route_queries(q).collect()]
    once = [tuple(r) for r in routing.route_queries(q.filter("query_id = 1").limit(1)).collect()]
    assert [r for r in got if r[0] == 1] == once * 2
    assert [r for r in got if r[0] == 2] == [(2, "arXiv", 0.0, 1)]
    assert any(r[0] is None and r[2] > 0 for r in got)


@pytest.mark.parametrize(("pattern", "factor"), [("rag", "rag"), ("self.?supervised", "supervised"), ("ab+c", "ab"), ("a|b", ""), ("x[yz]", ""), ("colou?r", "colo"), (r"\d+", ""), ("^deep net$", "deep net")])
def test_literal_factors(pattern, factor):
    assert routing.literal_factor(pattern) == factor


@pytest.mark.parametrize("word_bounds", [False, True])
def test_routing_same_as_a_search_for_each_pattern(spark, word_bounds):
    import re

    rng = random.Random(2)
    words = [re.sub(r"\.\?", " ", p) for p, *_ in KEYWORDS] + ["xx", "selfsupervised", "the", "fragment", "zero-shot"]
    rows = KEYWORDS + [("net|graph", 900, "c1", 2.0, 0), (r"\d{4}", 901, "c2", 0.5, 0), ("net|graph", 902, "c2", 1.5, 0)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(60)] + ["In 2024 nets", "\n", "SELF-SUPERVISED"]
    got = {}
    for r in routing.route_queries(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), rows, word_bounds=word_bounds).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.collection, r.score))
    for i, t in enumerate(texts):
        score, place = {}, {}
        for p, o, c, w, k in rows:
            if re.search(rf"\b(?:{p})\b" if word_bounds else p, t.lower()):
                score[c] = score.get(c, 0.0) + w
                place[c] = min(place.get(c, 10**9), o * 1000 + k)
        best = sorted((c for c in score if score[c] >= 0.5 * max(score.values()) - 1e-12), key=lambda c: (-round(score[c], 9), place[c]))[:3]
        want = [(n, c, pytest.approx(score[c])) for n, c in enumerate(best, 1)] or [(1, "arXiv", 0.0)]
        assert sorted(got[i]) == want


def test_cache_takes_the_last_write(spark):
    at = dt.datetime(2024, 1, 1)
    later = lambda n: at + dt.timedelta(seconds=n)
    entries = [("a", 1, later(0), later(1000)), ("a", 2, later(10), later(20)), ("b", 1, later(0), later(50)), ("b", 9, later(0), later(40)), ("c", 1, later(0), later(50)), ("c", 2, later(0), later(50))]
    e = spark.createDataFrame(entries, "key string, value int, written_at timestamp, expires_at timestamp")
    r = spark.createDataFrame([("a", later(15)), ("a", later(30)), ("b", later(30)), ("c", later(30)), ("a", later(5))], "key string, now timestamp")
    got = {(x.key, (x.now - at).seconds): x.value for x in cache.lookup(r, e).collect()}
    assert got == {("a", 15): 2, ("a", 30): None, ("b", 30): 1, ("c", 30): 2, ("a", 5): 1}


def test_titles_by_an_index(spark):
    rng = random.Random(4)
    titles = ["".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(150)] + ["A  Title", "title", None, "", "ti"]
    papers = spark.createDataFrame(list(enumerate(titles)), "paper_id long, title string")
    wanted = ["ab", "A", "bca", " TITLE ", "a title", "zzz", "", None, "ti", "ti", "  "]
    got = bib.titles_within(bib.title_index(papers), spark.createDataFrame([(w,) for w in wanted], "title string"), 3)
    plain = lambda t: " ".join((t or "").lower().split(" ")).strip() if t else ""
    import re

    plain = lambda t: re.sub(r"\s+", " ", t or "").strip(" ").lower()
    want = []
    for w in {plain(w) for w in wanted} - {""}:
        hits = sorted((len(plain(t)), i) for i, t in enumerate(titles) if w in plain(t))[:3]
        want += [(w, i, n) for n, (_, i) in enumerate(hits, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_prompt_is_filled_once(spark):
    row = spark.createDataFrame([("{contexts} and {query}", "one\n{query}"), (None, None)], "query string, contexts string")
    got = [r.p for r in row.select(context.answer_prompt(F.col("query"), F.col("contexts")).alias("p")).collect()]
    assert got[0] == context.ANSWER_PROMPT.replace("{contexts}", "\0").replace("{query}", "{contexts} and {query}").replace("\0", "one\n{query}")
    assert got[1] == context.ANSWER_PROMPT.replace("{contexts}", "").replace("{query}", "")


def test_hybrid_batch_same_as_single(spark, tmp_path):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(6)), i) for i in range(80)], "doc_id long, text string, year int")
    points = spark.createDataFrame([(i, [rng.random(), rng.random()], i) for i in range(80)], "vec_id long, embedding array<double>, year int")
    index = search.build_index(docs, f"file://{tmp_path}/i")
    queries = [(1, "a b", [1.0, 0.2]), (2, "h", [0.1, 1.0])]
    condition = search.conditions(20, 60)
    got = search.hybrid_batch(points, docs, index, spark.createDataFrame(queries, "query_id long, q string, v array<double>"), 5, condition)
    for i, q, v in queries:
        one = search.hybrid(points, docs, v, q, 5, condition, index=index)
        assert sorted(tuple(r) for r in got.filter(F.col("query_id") == i).select("id", "score", "rank").collect()) == sorted(tuple(r) for r in one.select("id", "score", "rank").collect())


def test_folders_of_files(spark, tmp_path):
    from quillon.sources import readers

    for name, content in (("a/x.pdf", b"%PDF-1.7 x"), ("a/y.PDF", b"no pdf"), ("b/c/z.pdf", b"\x00%PDF"), ("b/n.txt", b"%PDF")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    files = readers.pdf_files(spark, f"file://{tmp_path}")
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.is_pdf) for r in files.collect()) == [("x.pdf", 10, True), ("y.PDF", 6, False), ("z.pdf", 5, True)]
    assert sorted(r.collection for r in readers.collections_of_folders(files).collect()) == ["a", "c"]
    held = spark.createDataFrame([(9_999,), (10_001,), (None,)], "length long")
    assert [r.t for r in held.select(readers.already_there(F.col("length")).alias("t")).collect()] == [False, True, False]


def test_export_has_thirteen_columns(spark, tmp_path):
    from quillon.operators import store

    points = spark.createDataFrame([("p", "cs.LG  cs.AI", "A, B", "c", [1.0, 2.0], [3]), ("q", None, None, "d", [1.0], None), ("r", "x", None, "d", [0.0, 1.0], None)], "arxiv_id string, categories string, authors string, collection string, dense_embedding array<double>, sparse_indices array<int>")
    got = store.exported(points, 2)
    assert got.columns == list(store.EXPORTED) and [t for _, t in got.dtypes] == list(store.EXPORTED.values())
    one, two = got.orderBy("arxiv_id").collect()
    assert (one.categories, one.authors, one.doi, one.sparse_indices, one.sparse_values) == (["cs.LG", "cs.AI"], ["A", "B"], "", [3], [])
    assert (two.arxiv_id, two.categories, two.authors, two.dense_embedding) == ("r", ["x"], [], [0.0, 1.0])
    store.export_files(points.repartition(5), f"file://{tmp_path}/e", 2)
    assert len(list((tmp_path / "e").rglob("*.parquet"))) == 2


def test_scratch_is_released(spark):
    from quillon import session
    from quillon.plans import registry

    path = session.new_scratch_path(spark, "probe")
    spark.range(1).write.parquet(path)
    kept = set(session._given)
    try:
        session._given.clear()
        session._given.add(path)
        registry.release(spark)
        assert path not in session._given
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
    finally:
        session._given.update(kept - {path})
