"""Topics: clustering of chunk vectors by group, statistics and samples of clusters, sparse statistics, figure regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hierarchy
from .hierarchy import NOISE
from .search import usable

# Axes that topics are looked for on, samples for naming, areas of figures.
DIMS, SAMPLES, SAMPLE_CHARS = 5, 3, 300
#: Stands for a null group.
NO_GROUP = "\x00"
AREA_LOW, AREA_HIGH, EQUATION_AREA, TABLE_ASPECT = 0.02, 0.85, 0.05, 3.0


def principal(chunks: DataFrame, group: str, id_col: str, vec_col: str, dims: int = DIMS, most: int = 2_000) -> DataFrame:
    """g, id, p: the unit vectors of each group on its ``dims`` leading principal axes, each turned so that its largest component is positive.

    A task holds at most ``most`` vectors of a group: the axes of larger groups come from sums over parts. Vectors that are null or zero, hold null or
    non-finite components, or have another length than the commonest take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = chunks.select(F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("g"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["g", "id"])
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (size.d if size else 0))
    rows = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    small, large = rows.filter(F.col("n") <= most), rows.filter(F.col("n") > most)

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        x = np.stack(pdf["v"].to_numpy())
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def turned(axes: np.ndarray) -> np.ndarray:
        return axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], 1) < 0, -1, 1)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = unit(pdf)
        x = x - x.mean(axis=0)
        axes = turned(np.linalg.svd(x, full_matrices=False)[2][:dims])
        return pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "p": list(x @ axes.T)})

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = unit(pdf)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [len(x)], "s": [x.sum(axis=0)], "ss": [(x.T @ x).ravel()]})

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        n, s = pdf["n"].sum(), np.sum(pdf["s"].to_list(), axis=0)
        spread = np.sum(pdf["ss"].to_list(), axis=0).reshape(len(s), len(s)) - np.outer(s, s) / n
        found = turned(np.linalg.eigh(spread)[1][:, ::-1].T[:dims])
        return pd.DataFrame({"g": pdf["g"], "part": pdf["part"], "mean": [s / n] * len(pdf), "axes": [found.ravel()] * len(pdf)})

    def projected(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf)
        x = x - found["mean"].iloc[0]
        # row by row, so that equal vectors stay equal
        return pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "p": list(np.stack([(x * a).sum(axis=1) for a in found["axes"].iloc[0].reshape(-1, x.shape[1])], axis=1))})

    parts = large.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most))).groupBy("g", "part")
    summed = parts.applyInPandas(sums, "g string, part long, n long, s array<double>, ss array<double>")
    found = summed.groupBy("g").applyInPandas(axes, "g string, part long, mean array<double>, axes array<double>")
    projected = parts.cogroup(found.groupBy("g", "part")).applyInPandas(projected, "g string, id long, p array<double>")
    return small.groupBy("g").applyInPandas(whole, "g string, id long, p array<double>").unionByName(projected)


def topic_clusters(chunks: DataFrame, group: str, id_col: str, vec_col: str, most: int = 2_000, edges: int = hierarchy.EDGES, block: int = hierarchy.BLOCK) -> DataFrame:
    """grp, id, topic_id, topic_name, x, y: the density topics of each group's vectors (a document's chunks) on their leading axes, and a layout of them in the
    plane. -1 is noise, as are all vectors of groups under MIN_SIZE. Odd rows as in principal and density_topics."""
    points = hierarchy.kept(principal(chunks, group, id_col, vec_col, most=most), "principal")
    near = hierarchy.kept(hierarchy.neighbours(points, hierarchy.NEIGHBOURS, block), "near")
    labels, _ = hierarchy.density_topics(points, block=block, most=edges, near=near)
    out = labels.join(hierarchy.layout(points, near), ["g", "id"])
    return out.select(F.nullif("g", F.lit(NO_GROUP)).alias("grp"), "id", "topic_id", F.concat(F.lit("topic_"), F.col("topic_id").cast("string")).alias("topic_name"), "x", "y")


def topic_tree(chunks: DataFrame, group: str, id_col: str, vec_col: str, most: int = 2_000, edges: int = hierarchy.EDGES, block: int = hierarchy.BLOCK) -> DataFrame:
    """grp, cluster, within, size, stability, topic_id: every cluster of the density hierarchy, with the one that it is in."""
    _, clusters = hierarchy.density_topics(principal(chunks, group, id_col, vec_col, most=most), block=block, most=edges)
    return clusters.withColumn("g", F.nullif("g", F.lit(NO_GROUP))).withColumnRenamed("g", "grp")


def cluster_stats(rows: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Clusters without noise, and noise rows."""
    return rows.groupBy(*(by or [])).agg(F.count_distinct(F.when(F.col(label) != NOISE, F.col(label))).alias("n_clusters"), F.count_if(F.col(label) == NOISE).alias("n_noise"))


def cluster_samples(rows: DataFrame, label: str, id_col: str, text: str) -> DataFrame:
    """label, samples: the first texts of each cluster, shortened and joined."""
    w = Window.partitionBy(label).orderBy(id_col)
    first = rows.filter(F.col(label) != NOISE).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLES)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", F.left(text, F.lit(SAMPLE_CHARS)).alias("t")))), lambda x: x["t"])
    return first.groupBy(label).agg(F.array_join(parts, "\n---\n").alias("samples"))


def topic_names(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(name)), " ").alias("topics"))


def figure_kept(ratio: Column, drawing: Column) -> Column:
    """Area share of a page that a figure has; the bounds themselves count for images only."""
    return F.when(drawing, (ratio > AREA_LOW) & (ratio < AREA_HIGH)).otherwise((ratio >= AREA_LOW) & (ratio <= AREA_HIGH))


def region_type(ratio: Column, width: Column, height: Column) -> Column:
    return F.when(ratio < EQUATION_AREA, "equation").when(F.try_divide(width, height) > TABLE_ASPECT, "table").otherwise("figure")


def bounding_box(rows: DataFrame, by: list[str], least: int = 6) -> DataFrame:
    """The box around a page's drawings, for pages with ``least`` of them."""
    return rows.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")


def caption_valid(c: Column) -> Column:
    return F.coalesce((c != "") & ~F.startswith(c, F.lit("[")), F.lit(False))
