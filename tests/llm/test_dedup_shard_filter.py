import hashlib
import heapq
import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import components, exact_dedup, sharding, url_filter


def test_dedup_odd_rows(spark, odd, none):
    got = exact_dedup.exact_dedup(odd).toPandas()
    assert len(got) == odd.count() and exact_dedup.exact_dedup(none).count() == 0
    text = {i: t for i, t in odd.select("doc_id", "text").collect() if i is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        n = re.sub(r"[\x20\x09-\x0D]+", " ", text[r.doc_id] or "")
        assert r.text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    one = got[got.doc_id == 1].iloc[0]
    assert one.kept and one.group_size == 3 and one.keep_id == 1
    assert not got[got.doc_id == 2].kept.any()
    assert got.groupby("text_sha256").kept.sum().eq(1).all()
    empty = got[got.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert set(empty.keep_id) == {5} and empty.group_size.eq(3).all()  # null and empty texts


def test_dedup_compares_contents(spark):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    weak = lambda c: F.length(c).cast("string")  # noqa: E731  all texts share a digest
    got = exact_dedup.exact_dedup(rows, digest=weak).toPandas().sort_values("doc_id")
    assert list(got.keep_id) == [i % 7 for i in range(40)]
    assert got.kept.sum() == 7


def plain_lpt(sizes, shards):
    """Loads by longest-processing-time scheduling, a group at a time."""
    load = [(0, s) for s in range(shards)]
    for x in sorted(sizes, reverse=True):
        least, s = heapq.heappop(load)
        heapq.heappush(load, (least + x, s))
    return dict((s, x) for x, s in load)


def test_schedule_is_longest_first():
    assert sharding.schedule([(10, 1), (6, 2), (5, 1)], 2) == {10: [1, 0], 6: [0, 2], 5: [1, 0]}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 10_000), st.one_of(st.integers(1, 5), st.integers(50, 400)), max_size=12), st.integers(1, 7))
def test_schedule_equals_plain_lpt(sizes, shards):
    got = sharding.schedule(list(sizes.items()), shards)
    loads = {s: sum(x * n[s] for x, n in got.items()) for s in range(shards)}
    assert loads == plain_lpt([x for x, n in sizes.items() for _ in range(n)], shards)
    assert all(sum(got[x]) == n for x, n in sizes.items())


def test_shard_equals_plain_lpt_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, "long " * 3_000 + "x" * i * i) for i in range(30)], "doc_id long, text string"))
    groups = {}
    for r in docs.collect():
        groups[r.text or ""] = groups.get(r.text or "", 0) + len((r.text or "").encode()) + 8
    got = sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert sorted(r.b for r in got) == sorted(plain_lpt(groups.values(), 24).values())


def test_hot_texts_are_looked_up_alike(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 50}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = exact_dedup.exact_dedup(docs).toPandas()
    first, size = {}, {}
    for i, t in rows:
        first[t], size[t] = min(first.get(t, i), i), size.get(t, 0) + 1
    text = dict(rows)
    assert len(got) == 6_000 and all(r.keep_id == first[text[r.doc_id]] and r.group_size == size[text[r.doc_id]] for r in got.itertuples())
    assert sharding.shard(docs, 5).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def test_shard_odd_rows(spark, odd, none):
    got = sharding.shard(odd, 3).toPandas()
    assert len(got) == odd.count() and sharding.shard(none, 3).count() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got[got.doc_id == 2].shard.nunique() == 1
    assert got[got["size"] == 8].shard.nunique() == 1  # null and empty are one group
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_shards_are_even(spark):
    rows = spark.createDataFrame([(i, "x" * (i * 37 % 400)) for i in range(3000)], "doc_id long, text string")
    load = sharding.shard(rows).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(load) == 24 and load.max() - load.min() < 4000


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 5)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    assert components.connected_components(edges.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


URLS = ["http://a.EXAMPLE.com/en/71?q#f", "https://example.com/en/6", "http://com/en/", "http://xexample.com/en/7", "net/de/", None, "http://example.net/de/8", "http://x.net/de/8", "http://q.org?/es/", "http://q.org/es/", "http://", "a://b://c/d"]


def test_trie_and_join_agree(spark):
    rules = spark.createDataFrame(url_filter.CONTRACT_RULES + [("allow", "b.example.com", ""), ("block", "b.example.com", "/p/q"), ("allow", "q.org", "/es/"), ("block", "q.org", "/es/"), (None, "x", "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*URLS, "http://z.b.example.com/p/qq/r", "http://b.example.com/p"])], "page_id long, url string, RULE string")
    trie, join = url_filter.url_filter(pages, rules), url_filter.url_filter(pages, rules, max_broadcast_rules=2)
    a, b = (x.select("page_id", "host", "path", "rule", "verdict").toPandas().sort_values("page_id", ignore_index=True) for x in (trie, join))
    pd.testing.assert_frame_equal(a, b)
    got = dict(zip(a.page_id, zip(a.rule, a.verdict, strict=True), strict=True))
    assert got[0] == ("example.com/en/7", "allow") and got[1] == ("com/en/", "block") and got[3] == ("com/en/", "block")
    assert got[4] == got[5] == got[8] == (None, "allow") and got[6] == ("example.net/de/8", "block") and got[7] == ("net/de/", "block")
    assert got[9] == ("q.org/es/", "block") and got[12] == ("b.example.com/p/q", "block") and got[13] == ("b.example.com", "allow")
    assert a.host[0] == "a.example.com" and a.path[8] == "" and a.host[11] == "b:"
    assert "RULE" not in trie.columns and url_filter.url_filter(pages.limit(0), rules).count() == 0
