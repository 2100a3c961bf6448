"""Figure regions of pages from the boxes of their images and drawings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import make_importable
from .cluster import figure_kept, region_type

# Fixed value: drawings of a page from which on they make a figure.
DRAWINGS = 6
BOX = "x0 double, y0 double, x1 double, y1 double"


def merge_boxes(boxes: list[tuple[float, float, float, float]], counts: list[int] | None = None) -> list[tuple[float, float, float, float, int]]:
    """The boxes around sets of boxes (each there once, or ``counts`` times) that overlap or touch, and how many are in each; results that overlap are merged again, until none do. Boxes are
    swept from left to right, so each is compared only with those that still reach as far."""
    found = [(*b, n) for b, n in zip(boxes, counts or [1] * len(boxes), strict=True)]
    while True:
        found.sort()
        active: list[tuple[float, float, float, float, int]] = []
        done = []
        for x0, y0, x1, y1, n in found:
            done += [b for b in active if b[2] < x0]
            still = [b for b in active if b[2] >= x0]
            mine = [b for b in still if b[1] <= y1 and y0 <= b[3]]
            active = [b for b in still if not (b[1] <= y1 and y0 <= b[3])]
            mine.append((x0, y0, x1, y1, n))
            active.append((min(b[0] for b in mine), min(b[1] for b in mine), max(b[2] for b in mine), max(b[3] for b in mine), sum(b[4] for b in mine)))
        done += active
        if len(done) == len(found):
            return sorted(done)
        found = done


def linked_boxes(boxes: list[tuple[float, float, float, float]], counts: list[int] | None = None) -> list[tuple[float, float, float, float, int]]:
    """merge_boxes by the given boxes alone: only these link, not the larger boxes around them. At each height where a box begins or ends, the sweep keeps how far
    to the right the boxes there reach and the last one of them: all others that reach as far are linked with that one already."""
    counts = counts or [1] * len(boxes)
    order = sorted(range(len(boxes)), key=lambda i: boxes[i])
    root = list(range(len(boxes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    heights = np.unique([y for b in boxes for y in (b[1], b[3])])
    reach, last = np.full(len(heights), -np.inf), np.full(len(heights), -1)
    begin, end = np.searchsorted(heights, [b[1] for b in boxes]), np.searchsorted(heights, [b[3] for b in boxes])
    for i in order:
        x0, _, x1, _ = boxes[i]
        far, own = reach[begin[i] : end[i] + 1], last[begin[i] : end[i] + 1]
        for j in np.unique(own[(own >= 0) & (far >= x0)]).tolist():
            root[top(i)] = top(j)
        np.maximum(far, x1, out=far)
        own[:] = i
    sets: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        sets.setdefault(top(i), []).append(i)
    around = lambda own: (min(boxes[i][0] for i in own), min(boxes[i][1] for i in own), max(boxes[i][2] for i in own), max(boxes[i][3] for i in own), sum(counts[i] for i in own))
    return sorted(around(own) for own in sets.values())


@F.udtf(returnType=f"{BOX}, n int")
class Regions:
    """Table function: a page's different boxes, array<struct<x0,y0,x1,y1,n>>, each there n times, as the boxes around those that hang together, by merge_boxes if they are to be
    ``apart``, else by linked_boxes. Boxes with a null or an
    end before its start take no part."""

    def eval(self, boxes: list, apart: bool) -> Iterator[tuple]:
        own = [tuple(b) for b in boxes or [] if b is not None and None not in tuple(b) and b[0] <= b[2] and b[1] <= b[3]]
        yield from (merge_boxes if apart else linked_boxes)([b[:4] for b in own], [b[4] for b in own])


def drawing_regions(drawings: DataFrame, by: list[str], apart: bool = True, least: int = 1) -> DataFrame:
    """by, x0, y0, x1, y1, n: the regions of each page's drawings (by, x0, y0, x1, y1), those of ``least`` drawings or more. A page is a list of bounded size; boxes
    that are there many times are looked at once."""
    make_importable(drawings.sparkSession)
    ends = ["x0", "y0", "x1", "y1"]
    each = drawings.select(*by, *[F.col(c).cast("double").alias(c) for c in ends]).groupBy(*by, *ends).agg(F.count(F.lit(1)).alias("n"))
    pages = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*ends, "n"))).alias("boxes"))
    return pages.lateralJoin(Regions(F.col("boxes").outer(), F.lit(apart))).select(*by, "x0", "y0", "x1", "y1", "n").filter(F.col("n") >= least)


def page_regions(pages: DataFrame, images: DataFrame, drawings: DataFrame, by: list[str], least: int = DRAWINGS) -> DataFrame:
    """by, x0, y0, x1, y1, region_type: what is a figure of a page (by, width, height): its images of fitting size, by kind, and of pages with ``least`` drawings the box
    around all of them, if that fits."""
    area = F.col("width") * F.col("height")
    ratio = F.try_divide((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), area)
    some = images.join(pages, by).filter(figure_kept(ratio, F.lit(False)))
    kinds = some.select(*by, "x0", "y0", "x1", "y1", region_type(ratio, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("region_type"))
    ends = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")]
    around = drawings.groupBy(*by).agg(*ends).filter(F.col("n") >= least).join(pages, by).filter(figure_kept(ratio, F.lit(True)))
    return kinds.unionByName(around.select(*by, "x0", "y0", "x1", "y1", F.lit("figure").alias("region_type")))
