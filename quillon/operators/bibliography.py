"""Bibliographic tables: what search tools over papers, authors and citations do with rows, once these are in tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Papers of an author that are shown, papers that a search or recommendation gives, the least score of a passage.
AUTHOR_PAPERS, FOUND, LEAST_SCORE, RECENT_DAYS, RECENT = 20, 10, 0.25, 7, 20
#: References on a page of a citation list.
PAGE = 100


def recent(papers: DataFrame, now: Column, category: str | None = None, keyword: str | None = None, days: int = RECENT_DAYS, most: int = RECENT, at: str = "published", text: str = "abstract", id_col: str = "paper_id") -> DataFrame:
    """Papers of the last ``days`` days, of a category, with a keyword in title or text (any case), newest first, ``most`` of them, with rank.
    Papers without a date aren't recent."""
    fits = (F.col(at) <= now) & (F.col(at) > now - F.make_dt_interval(days=F.lit(days)))
    if category:
        fits &= F.array_contains(F.split(F.coalesce("categories", F.lit("")), r"\s+"), category)
    if keyword:
        fits &= F.contains(F.lower(F.concat_ws(" ", "title", text)), F.lit(keyword.lower()))
    return newest(papers.filter(fits), at, id_col, most)


def newest(papers: DataFrame, at: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` last papers by date or year, ties to the smaller id, with rank; those without one come last."""
    order = [F.desc_nulls_last(at), F.col(id_col)]
    return papers.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def author_papers(papers: DataFrame, author: str = "author_id", year: str = "year", id_col: str = "paper_id", most: int = AUTHOR_PAPERS) -> DataFrame:
    """Each author's papers by descending year, a missing one counting as 0, ``most`` of them, with rank; ties go to the smaller id."""
    w = Window.partitionBy(author).orderBy(F.coalesce(F.col(year), F.lit(0)).desc(), id_col)
    return papers.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def with_url(papers: DataFrame, prefix: str, id_col: str = "paper_id", url: str = "url") -> DataFrame:
    """A missing or empty address is made from the id."""
    return papers.withColumn(url, F.coalesce(F.nullif(F.col(url), F.lit("")), F.concat(F.lit(prefix), F.col(id_col).cast("string"))))


def flattened_pdf(papers: DataFrame, pdf: str = "open_access_pdf") -> DataFrame:
    """pdf_url in place of the struct that holds it."""
    return papers.withColumn("pdf_url", F.col(f"{pdf}.url")).drop(pdf)


def passages(hits: DataFrame, by: str = "query_id", score: str = "score", id_col: str = "id", least: float = LEAST_SCORE, most: int = FOUND) -> DataFrame:
    """Each query's hits with a score of ``least`` at least, best first, ``most`` of them, with rank."""
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return hits.filter(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def recommended(similar: DataFrame, paper: str = "paper_id", other: str = "other_id", score: str = "score", most: int = FOUND) -> DataFrame:
    """Each paper's nearest others by a similarity table, itself left out: recommendations, or a similarity graph's neighbours."""
    w = Window.partitionBy(paper).orderBy(F.desc(score), other)
    return similar.filter(F.col(paper) != F.col(other)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def prior_works(edges: DataFrame, graph: DataFrame, most: int = FOUND, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """paper, n, rank: the papers that most of the graph's nodes cite. With src and dst exchanged, derivative works: those that cite most of them."""
    cited = edges.join(graph.select(F.col(node).alias(src)).distinct(), src, "left_semi").groupBy(F.col(dst).alias("paper")).agg(F.count_distinct(src).alias("n"))
    order = [F.desc("n"), F.col("paper")]
    return cited.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def found_summaries(found: DataFrame, summaries: DataFrame, most: int = FOUND, by: str = "query_id", key: str = "id", pos: str = "pos") -> DataFrame:
    """Two steps: a search's first ``most`` ids, then their summaries, in the search's order. Ids without a summary stay, without one."""
    w = Window.partitionBy(by).orderBy(pos)
    first = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return first.join(summaries, key, "left")


def page_of(rows: DataFrame, page: int, size: int, order: str, by: str) -> DataFrame:
    """Page number ``page`` (from 1) of each group's rows in an order, with pos (from 1 over all pages). Past the end there is nothing."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("pos", F.row_number().over(w)).filter((F.col("pos") > (page - 1) * size) & (F.col("pos") <= page * size))


def paged(rows: DataFrame, by: str, order: str, size: int = PAGE, most: int | None = None) -> DataFrame:
    """Rows with page (from 1), as an API would give them page by page: a short page, or ``most`` rows, ends a list."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("pos", F.row_number().over(w))
    out = out if most is None else out.filter(F.col("pos") <= most)
    return out.withColumn("page", (F.floor((F.col("pos") - 1) / F.lit(size)) + 1).cast("int"))


def batch_number(position: Column, size: int) -> Column:
    """The number, from 0, of the fixed-size batch that a row at a place (from 1) is in."""
    return F.floor((position - 1) / F.lit(size)).cast("int")


def derived_urls(pmcid: Column, doi: Column, base: str = "https://example.org/pmc/", resolver: str = "https://doi.org/") -> Column:
    """An address by the archive's id, else by the DOI, else null."""
    there = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.concat(F.lit(base), there(pmcid)), F.concat(F.lit(resolver), there(doi)))


def plain_title(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def by_title(papers: DataFrame, title: Column, most: int = 1, col: str = "title", id_col: str = "paper_id") -> DataFrame:
    """Papers whose title has the given one in it, in any case and spacing; the shortest titles first, ``most`` of them. One scan; see titles_within for many."""
    hits = papers.filter(F.contains(plain_title(F.col(col)), plain_title(title)) & (plain_title(title) != ""))
    return hits.orderBy(F.length(col), id_col).limit(most)


def _grams(c: Column, n: int | Column) -> Column:
    """Distinct parts of n characters; none of shorter text."""
    last = F.length(c) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n) if isinstance(n, int) else n)))).otherwise(F.array().cast("array<string>"))


def title_index(papers: DataFrame, col: str = "title", id_col: str = "paper_id") -> DataFrame:
    """id, title, gram: a row for each distinct part of one to three characters of each different title, plain, without an id, and one for each paper, without
    a gram; to be stored where it is asked often. So a title that many papers have is cut up once."""
    t = papers.select(F.col(id_col).alias("id"), plain_title(F.col(col)).alias("title")).filter("title <> ''")
    grams = t.select("title").distinct().select("title", F.explode(F.concat(*[_grams(F.col("title"), n) for n in (1, 2, 3)])).alias("gram"))
    return t.withColumn("gram", F.lit(None).cast("string")).unionByName(grams, allowMissingColumns=True)


def titles_within(index: DataFrame, wanted: DataFrame, most: int = 1, title: str = "title") -> DataFrame:
    """wanted, id, rank: of every distinct wanted title those indexed titles that have it in them, the shortest first, ``most`` of them.

    A wanted title is looked up by the rarest of its parts of three characters (shorter titles by themselves), and only what has that part is compared, so
    no pair of titles meets without sharing it. Of the papers of one title only the first ``most`` meet what is looked for. Wanted titles that are null or
    blank find nothing.
    """
    grams = index.filter(F.col("gram").isNotNull()).select("title", "gram")
    first = index.filter(F.col("gram").isNull()).select("title", "id").withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy("id"))).filter(F.col("k") <= most).drop("k")
    asked = wanted.select(plain_title(F.col(title)).alias("wanted")).filter("wanted <> ''").distinct()
    parts = asked.select("wanted", F.explode(_grams(F.col("wanted"), F.least(F.lit(3), F.length("wanted")))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(counts, "gram", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("wanted", "r.gram")
    hits = grams.join(rarest, "gram").filter(F.contains("title", F.col("wanted"))).select("wanted", "title").join(first, "title")
    w = Window.partitionBy("wanted").orderBy(F.length("title"), "id")
    return hits.select("wanted", "id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= most)


def open_access(references: DataFrame, lookup: DataFrame, doi: str = "doi") -> DataFrame:
    """References with found_url, by DOI in any case: the best place's PDF, else its page, else empty. lookup(doi, pdf_url, url); of
    several rows of a DOI the first in that order counts."""
    there = lambda c: F.nullif(F.col(c), F.lit(""))
    best = lookup.filter(F.col(doi).isNotNull()).groupBy(F.lower(doi).alias("__doi")).agg(F.coalesce(F.min(there("pdf_url")), F.min(there("url")), F.lit("")).alias("found_url"))
    return references.join(best, F.lower(F.col(doi)) == F.col("__doi"), "left").drop("__doi").withColumn("found_url", F.coalesce("found_url", F.lit("")))


def paper_files(papers: DataFrame, files: DataFrame, id_of: Column, key: str = "paper_id", path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """papers with the first path, in order, whose file name has the paper's id (``id_of`` the path); null without one. An equi-join, as the
    id is taken from the name instead of looked for in all names. Where ids are told apart within a collection only, ``by`` names the columns that say which one
    a paper and a file belong to."""
    named = files.select(id_of.alias("__id"), *by, F.col(path)).filter(F.col("__id").isNotNull()).groupBy("__id", *by).agg(F.min(path).alias(path))
    return papers.withColumn("__id", F.col(key)).join(named, ["__id", *by], "left").drop("__id")


def search_address(prefix: str, query: Column) -> Column:
    """A search page's address for a query."""
    return F.concat(F.lit(prefix), F.url_encode(query))


def dispatch(requests: DataFrame, answers: dict[tuple[str, str], DataFrame], service: str = "service", action: str = "action", key: str = "key") -> DataFrame:
    """One table for all services: each request meets the answer table of its service and action by key; others get no answer."""
    out = None
    known = F.lit(False)
    for (s, a), table in answers.items():
        mine = (F.col(service) == s) & (F.col(action) == a)
        known |= F.coalesce(mine, F.lit(False))
        part = requests.filter(mine).join(table.select(key, "answer"), key, "left").select(*requests.columns, "answer")
        out = part if out is None else out.unionByName(part)
    rest = requests.filter(~known).withColumn("answer", F.lit(None).cast("string"))
    return rest if out is None else out.unionByName(rest)
