"""Regions of overlapping boxes against plain unions."""

import random

import pytest

from quillon.operators import figures


def overlap(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def around(some):
    return min(b[0] for b in some), min(b[1] for b in some), max(b[2] for b in some), max(b[3] for b in some)


def plain(boxes, apart):
    """Join any two sets that overlap until none do: by their boxes around (apart), or by the boxes that they hold."""
    sets = [[b] for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(sets)) for j in range(i) if (overlap(around(sets[i]), around(sets[j])) if apart else any(overlap(a, b) for a in sets[i] for b in sets[j]))), None)
        if pair is None:
            return sorted((*around(s), len(s)) for s in sets)
        sets[pair[1]] += sets.pop(pair[0])


def boxes_of(rng, n, size):
    out = []
    for _ in range(n):
        x, y = rng.uniform(0, 50), rng.uniform(0, 50)
        out.append((x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_sweep_same_as_all_pairs(seed):
    rng = random.Random(seed)
    boxes = boxes_of(rng, rng.randrange(40), rng.choice([1, 4, 12]))
    assert figures.merge_boxes(boxes) == plain(boxes, True)
    assert figures.linked_boxes(boxes) == plain(boxes, False)


def test_table_function(spark):
    rng = random.Random(1)
    pages = {f"p{k}": boxes_of(rng, 25, 6) for k in range(4)}
    rows = [(p, *b) for p, own in pages.items() for b in own] + [("p0", None, 1.0, 2.0, 2.0), ("p0", 5.0, 5.0, 4.0, 6.0), ("empty", None, None, None, None)]
    df = spark.createDataFrame(rows, "page string, x0 double, y0 double, x1 double, y1 double")
    for apart in (True, False):
        got = {}
        for r in figures.drawing_regions(df, ["page"], apart).collect():
            got.setdefault(r.page, []).append(tuple(r)[1:])
        assert {p: sorted(x) for p, x in got.items()} == {p: plain(own, apart) for p, own in pages.items()}
    assert figures.drawing_regions(df, ["page"], least=100).count() == 0


def test_regions_of_a_page(spark):
    pages = spark.createDataFrame([("a", 100.0, 100.0), ("b", 100.0, 100.0), ("c", 0.0, 0.0)], "page string, width double, height double")
    box = "page string, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 20.0), ("a", 0.0, 0.0, 20.0, 5.0), ("a", 0.0, 0.0, 80.0, 20.0), ("a", 0.0, 0.0, 50.0, 50.0), ("a", 0.0, 0.0, 100.0, 90.0), ("c", 0.0, 0.0, 1.0, 1.0)], box)
    drawings = spark.createDataFrame([("a", float(k), 0.0, k + 1.0, 1.0) for k in range(5)] + [("b", 10.0 * k, 10.0 * k, 10.0 * k + 5, 10.0 * k + 5) for k in range(6)], box)
    got = sorted((r.page, r.x1, r.y1, r.region_type) for r in figures.page_regions(pages, images, drawings, ["page"]).collect())
    assert got == [("a", 10.0, 20.0, "equation"), ("a", 50.0, 50.0, "figure"), ("a", 80.0, 20.0, "table"), ("b", 55.0, 55.0, "figure")]
