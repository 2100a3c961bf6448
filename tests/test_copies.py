"""Tables that hold the same rows many times over: work goes by what differs, results by all rows."""

import math
import time

from pyspark.sql import functions as F

from quillon.operators import bibliography, figures, hierarchy, store
from quillon.plans import tool_plans


def plain_cut(points, reach, k):
    core, links = {}, {}
    for i, p in points.items():
        far = sorted(math.dist(p, q) for j, q in points.items() if j != i)
        core[i] = far[min(k, len(far)) - 1] if far else None
    part = {i: i for i in points}
    links = [(i, j) for i in points for j in points if i < j and max(math.dist(points[i], points[j]), core[i], core[j]) <= reach]
    for _ in points:
        for i, j in links:
            part[i] = part[j] = min(part[i], part[j])
    return {i: (None if core[i] is None else round(core[i], 9), part[i]) for i in points}


def test_density_parts_measures_places_once(spark, monkeypatch):
    groups = {"a": {i: (float(i % 9 * 3), float(i % 4)) for i in range(120)}, "b": {i: (float(i * i % 31), 0.0) for i in range(12)}, "c": {5: (1.0, 1.0)}, "d": {7: (0.0, 0.0), 8: (0.0, 0.0), 9: (9.0, 0.0)}}
    rows = [(g, i, list(p)) for g, ps in groups.items() for i, p in ps.items()]
    points = spark.createDataFrame(rows, "g string, id long, p array<double>")
    met, plain = [], hierarchy.neighbours
    monkeypatch.setattr(hierarchy, "neighbours", lambda x, k, block: met.append(x.count()) or plain(x, k, block))
    for most in (hierarchy.EDGES, 2):  # one task a group, and rounds
        got = {(r.g, r.id): (None if r.core is None else round(r.core, 9), r.part) for r in hierarchy.core_and_parts(points, 2.0, block=16, most=most).collect()}
        assert got == {(g, i): x for g, ps in groups.items() for i, x in plain_cut(ps, 2.0, hierarchy.MIN_SAMPLES).items()}
    assert met == [len({(g, tuple(p)) for g, _, p in rows})] * 2


def test_titles_are_cut_up_once(spark):
    rows = [(i, f"Old {'ring' if i % 3 else 'plate'}") for i in range(300)] + [(900, "ring"), (901, None), (902, " ")]
    index = bibliography.title_index(spark.createDataFrame(rows, "paper_id long, title string"))
    assert index.filter("gram IS NOT NULL").count() == sum(len({t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1)}) for t in ("old ring", "old plate", "ring"))
    got = {(r.wanted, r.rank): r.id for r in bibliography.titles_within(index, spark.createDataFrame([("RING",), ("Old  plate",), ("x",)], "title string"), 3).collect()}
    assert got == {("ring", 1): 900, ("ring", 2): 1, ("ring", 3): 2, ("old plate", 1): 0, ("old plate", 2): 3, ("old plate", 3): 6}


def test_of_one_batch_the_row_written_last_stays(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", "id", buckets=3)
    for name in ("first", "second", "third"):
        s.upsert("c", spark.range(20_000 if name == "first" else 60).selectExpr("id", f"'{name}' AS source", "1 AS batch"))
    assert any(len(x) > 1 for x in s.state("c").parts.values())
    assert {(r.source, r.n) for r in s.read("c").groupBy("source").agg(F.count("*").alias("n")).collect()} == {("third", 60), ("first", 19_940)}
    s.fold("c", share=0)
    assert {(r.source, r.n) for r in s.read("c").groupBy("source").agg(F.count("*").alias("n")).collect()} == {("third", 60), ("first", 19_940)}


def test_paper_files_of_several_volumes(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (0, 1, 2, 50000, 50001, 50002, 100001)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.paper_id: r.path for r in tool_plans.paper_file_join(spark, str(tmp_path)).collect()}
    assert got == {i: f"a/2101.{i % 50000:05d}v2.pdf" if i % 3 else None for i in (0, 1, 2, 50000, 50001, 50002, 100001)}


def test_boxes_that_are_there_many_times_are_looked_at_once(spark, monkeypatch):
    boxes = [(float(i % 7), float(i % 5) * 3, float(i % 7) + 0.5, float(i % 5) * 3 + 1) for i in range(350)]
    df = spark.createDataFrame([("p", *b) for b in boxes], "page string, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in figures.drawing_regions(df, ["page"], apart=False).collect())
    assert got == [(*b, 10) for b in sorted(set(boxes))] == sorted(tuple(r)[1:] for r in figures.drawing_regions(df, ["page"]).collect())
    many = [(float(i % 2), i % 1_000 + 0.0, i % 2 + 3.0, i % 1_000 + 800.0) for i in range(12_000)]
    begun = time.monotonic()
    assert figures.linked_boxes(many) == [(0.0, 0.0, 4.0, 1_799.0, 12_000)]
    assert time.monotonic() - begun < 10  # by pairs of boxes it took 48 s
