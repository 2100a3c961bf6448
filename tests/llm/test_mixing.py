import hashlib
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing

D = "/root/testdata/sf0.001"


def test_targets_stop_at_twice_the_source_and_share_the_rest():
    assert mixing.targets_of([100, 100, 100], [5, 2, 1], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets_of([10, 10, 1000], [5, 2, 1], 1000) == [20, 20, 960]
    assert mixing.targets_of([0, 10], [1, 1], 15) == [0, 15]
    assert mixing.targets_of([10, 10], [1, 1], 100) == [20, 20]
    assert mixing.targets_of([], [], 0) == []


def cost(capacity, given):
    """The n-th repetition of a word costs n."""
    return sum(sum(max(0, g - n * c) for n in range(3)) for c, g in zip(capacity, given, strict=True))


@pytest.mark.parametrize("seed", range(25))
def test_route_fills_quotas_at_least_cost(seed):
    import random

    rng = random.Random(seed)
    members = [tuple(sorted(rng.sample(range(3), rng.randrange(1, 4)))) for _ in range(3)]
    capacity, quotas = [rng.randrange(3) for _ in members], [rng.randrange(5) for _ in range(3)]
    best = (0, 0)
    edges = [(p, s) for p, m in enumerate(members) for s in m]
    for flow in itertools.product(range(5), repeat=len(edges)):
        given, got = [0] * 3, [0] * 3
        for (p, s), n in zip(edges, flow, strict=True):
            given[p] += n
            got[s] += n
        if all(g <= 2 * c for g, c in zip(given, capacity, strict=True)) and all(g <= q for g, q in zip(got, quotas, strict=True)):
            best = max(best, (sum(got), -cost(capacity, given)))
    sent = mixing.route(capacity, members, quotas)
    given, got = [sum(x.values()) for x in sent], [sum(x.get(s, 0) for x in sent) for s in range(3)]
    assert all(set(x) <= set(m) for x, m in zip(sent, members, strict=True))
    assert all(g <= 2 * c for g, c in zip(given, capacity, strict=True)) and all(g <= q for g, q in zip(got, quotas, strict=True))
    assert (sum(got), -cost(capacity, given)) == best


def brute(docs, plan, seed=0, repeats=2):
    """docs: (doc_id, text, sources) -> (doc_id, size, taken, {source: words}) along each pattern's line, word by word."""
    groups = {}
    for i, text, own in docs:
        pattern = tuple(mixing.by_code_point(set(own or [])))
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        groups.setdefault(pattern, []).append((hashlib.md5(f"{seed}:{'' if i is None else i}:{text or ''}".encode()).hexdigest(), i, size))
    out = []
    for pattern, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        line = [k for k, r in enumerate(rows) for _ in range(r[2])] * repeats
        taken, at = [{} for _ in rows], 0
        for s, n in plan.routes.get(pattern, []):
            for k in line[at : at + n]:
                taken[k][plan.sources[s][0]] = taken[k].get(plan.sources[s][0], 0) + 1
            at += n
        out += [(r[1], r[2], sum(t.values()), t) for r, t in zip(rows, taken, strict=True)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.size, r.taken, {x.source: x.words for x in r.routed}) for r in df.collect()], key=str)


def test_overlapping_sources_same_as_brute_force(spark):
    import random

    rng = random.Random(1)
    docs = [(i, "w " * rng.randrange(40), rng.choice([["a"], ["b", "a"], ["c"], ["c", "b", "b"], [None], [None, "a"], [], None])) for i in range(400)]
    docs += [docs[5], docs[5], (None, "x y z", ["a"]), (None, "x y z", ["a"]), (7, None, ["b"]), (8, "", ["b"]), (9, "long " * 20_000, ["b"])]
    df = spark.createDataFrame([(i, t, s, "n", 1) for i, t, s in docs], "doc_id long, text string, own array<string>, size string, Taken int").repartition(6)
    got, plan = mixing.mix(df, F.col("own"))
    rows = rows_of(got)
    assert rows == brute(docs, plan)
    assert all(r[2] <= 2 * r[1] for r in rows)
    for name, have, target, routed in plan.sources:
        assert routed == sum(r[3].get(name, 0) for r in rows)
        assert target <= 2 * have
    # no flow is larger than the smallest cut: the quotas of some sources, and what patterns have that belong to another
    words = {}
    for _, text, own in docs:
        p = tuple(sorted(set(own or []), key=str))
        words[p] = words.get(p, 0) + len((text or "").split())
    cuts = [sum(int(t) for s, _, t, _ in plan.sources if s in some) + sum(2 * n for p, n in words.items() if not set(p) <= set(some)) for k in range(5) for some in itertools.combinations([s for s, *_ in plan.sources], k)]
    assert sum(r for *_, r in plan.sources) == min(cuts)
    again, _ = mixing.mix(df.repartition(3), F.col("own"))
    assert rows_of(again) == rows


def test_quotas_that_only_repetition_fills_take_from_who_has_most(spark):
    docs = [(i, "a b c d e", ["x"] if i < 2 else ["x", "y"]) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, own array<string>")
    got, plan = mixing.mix(df, F.col("own"), weights={"x": 1.0, "y": 1.0}, share=200)
    assert [(s, n, t, r) for s, n, t, r in plan.sources] == [("x", 20, 20.0, 20), ("y", 10, 20.0, 20)]
    assert {r.doc_id: r.taken for r in got.collect()} == dict.fromkeys(range(4), 10)


def test_op11_same_as_sql_and_near_its_targets(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = con.sql(mixing.OP11_SQL)
    got = mixing.op11(spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall())
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t <= r.target < r.t + 1 for r in sums)


def test_odd_rows(spark, odd, none):
    rows, plan = mixing.mix(odd, F.array("source"))
    got = rows.collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    assert [s for s, *_ in plan.sources] == ["s", None]
    assert mixing.mix(none, F.array("source"))[0].collect() == []
    empty = spark.createDataFrame([(1, "", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(empty, F.array("source"))[0].collect()] == [0, 0]
