"""Crawls over stored pages: link edges under a seed, breadth first, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import join_url, page_content
from ..functions.text import clean_title, defragment, links, old_version, skipped_url, under_seed, url_authority
from .chunking import chunk_flat
from .graph import levels
from .store import not_done


def link_edges(pages: DataFrame, seed: str) -> DataFrame:
    """src, dst: links of each page (url, html) that a crawl from the seed would follow."""
    rows = pages.select(defragment(F.col("url")).alias("src"), "url", F.explode(links(F.col("html"))).alias("href"))
    found = rows.select("src", defragment(join_url(F.col("url"), F.col("href"))).alias("dst")).filter(F.col("dst").isNotNull())
    s = F.lit(seed)
    return found.filter(under_seed(F.col("dst"), s) & ~skipped_url(F.col("dst")) & ~old_version(F.col("dst"), s)).distinct()


def crawl(pages: DataFrame, seed: str, depth: int = -1) -> DataFrame:
    """url, level: pages reached from the seed; depth -1 has no limit, 0 is the seed alone."""
    start = pages.sparkSession.createDataFrame([(seed.split("#")[0],)], "url string")
    return levels(link_edges(pages, seed), start, depth).select(F.col("node").alias("url"), "level")


def crawl_sites(pages: DataFrame, seeds: DataFrame, depth: int = -1, extra: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """seed, url, level: many crawls at once, each of the pages (url, html) under its seed (seeds: their first column). extra (seed, url): further addresses at
    level 0, of a sitemap say; of these only such as a crawl from the seed would follow. With a path a killed crawl goes on after its last
    complete level, see graph.levels."""
    start = seeds.select(defragment(F.col(seeds.columns[0])).alias("seed")).dropna().distinct()
    rows = pages.select(defragment(F.col("url")).alias("src"), "url", F.explode(links(F.col("html"))).alias("href"))
    found = rows.select("src", defragment(join_url(F.col("url"), F.col("href"))).alias("dst"), url_authority(F.col("url")).alias("host")).filter(F.col("dst").isNotNull()).distinct()
    # links leave no authority, so pages meet the seeds of their own
    met = found.join(start.withColumn("host", url_authority(F.col("seed"))), "host")
    s = F.col("seed")
    follows = lambda u: under_seed(u, s) & ~skipped_url(u) & ~old_version(u, s)
    edges = met.filter(follows(F.col("dst"))).select(F.struct("seed", F.col("src").alias("url")).alias("src"), F.struct("seed", F.col("dst").alias("url")).alias("dst"))
    first = start.select(F.struct("seed", F.col("seed").alias("url")).alias("node"))
    if extra is not None:
        more = extra.select(defragment(F.col("seed")).alias("seed"), defragment(F.col("url")).alias("url")).join(start, "seed", "left_semi").filter(follows(F.col("url")))
        first = first.unionByName(more.select(F.struct("seed", "url").alias("node")))
    return levels(edges, first, depth, path=path).select("node.seed", "node.url", "level")


def page_chunks(pages: DataFrame, done: DataFrame | None = None, size: int = 512, overlap: int = 64) -> DataFrame:
    """url, title, section, chunk_idx, token_count, chunk_text of pages that weren't ingested before."""
    rows = pages if done is None else not_done(pages, done, "url")
    parsed = rows.select("url", page_content(F.col("html")).alias("p")).select("url", clean_title(F.col("p.title")).alias("title"), "p.section", "p.text")
    return chunk_flat(parsed, size, overlap, id_col="url", keep=("title", "section")).withColumnRenamed("doc_id", "url")
