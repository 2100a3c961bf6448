"""Readers: metadata lines, progress files, collections, crawl configurations, seeds, sitemaps, manifests, binary folders."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import defragment, one_line, skipped_url, squeeze, strip, under_seed, year_of
from ..operators.store import first_of

RAW_METADATA = "id string, arxiv_id string, title string, abstract string, authors string, categories string, update_date string, `journal-ref` string, journal_ref string"
QA = "query string, relevant_ids array<string>, collection string, notes string, ground_truth string"
MANIFEST = (
    "source struct<arxiv_id:string,title:string,authors:array<string>,year:int,semantic_scholar_id:string>, level int, fetched_at timestamp, "
    "references array<struct<title:string,authors:array<string>,year:int,arxiv_id:string,doi:string,semantic_scholar_id:string,open_access_pdf:string,"
    "citation_count:int,availability:string,downloaded:boolean,ingested:boolean,collection:string>>"
)


def raw_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped; either spelling of the id and journal fields."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = spark.read.schema(RAW_METADATA).option("mode", "DROPMALFORMED").json(path)
    return rows.select(
        F.coalesce(given("id"), given("arxiv_id")).alias("arxiv_id"), "title", "abstract", "authors", "categories", "update_date", F.coalesce(given("`journal-ref`"), given("journal_ref")).alias("journal_ref")
    ).filter(F.col("arxiv_id").isNotNull())


def normalised_papers(raw: DataFrame, min_year: int = 2000) -> DataFrame:
    """Cleaned papers; one whose year is known and below ``min_year`` goes."""
    text = lambda c: F.coalesce(one_line(F.col(c)), F.lit("")).alias(c)
    year = year_of(F.col("update_date"))
    rows = raw.select("arxiv_id", text("title"), text("abstract"), F.coalesce(squeeze(F.col("authors")), F.lit("")).alias("authors"), F.coalesce("categories", F.lit("")).alias("categories"), year.alias("year"), "update_date", "journal_ref")
    return rows.filter(F.col("year").isNull() | (F.col("year") >= min_year))


def loadable(papers: DataFrame) -> DataFrame:
    """Papers with an id and an abstract."""
    return papers.filter((F.col("arxiv_id") != "") & (F.col("abstract") != ""))


def long_abstracts(papers: DataFrame, over: int = 50) -> DataFrame:
    return papers.filter(F.length("abstract") > over)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines as ``id``; no file yet is an empty set."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).filter(F.col("id") != "").distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    return lines.select(F.element_at(F.split("line", r"\s+"), 1).alias("id"))


def file_paper_id(path: Column) -> Column:
    """The paper id in a file's name, without version; null if there is none."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}\.\d{4,5})(?:v\d+)?", 1), F.lit(""))


def scan_collection(spark: SparkSession, path: str, collection: str, columns: Sequence[str]) -> DataFrame:
    """Columns of one partition: others, vectors too, aren't read."""
    return spark.read.parquet(path).filter(F.col("collection") == collection).select(*columns)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, is_pdf of all PDF files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    return files.select("path", "length", "content", F.contains(F.substring(F.col("content"), 1, 8).cast("string"), F.lit("%PDF")).alias("is_pdf"))


def collections_of_folders(files: DataFrame) -> DataFrame:
    """Names of the folders that hold PDF files."""
    return files.select(F.element_at(F.split("path", "/"), -2).alias("collection")).distinct()


def crawl_config(spark: SparkSession, toml: str) -> DataFrame:
    """collection, tag, depth, url, description: one row for each target of a TOML text."""
    c = tomllib.loads(toml)
    rows = [(c.get("collection"), c.get("tag"), int(c.get("depth", -1)), t.get("url"), t.get("description")) for t in c.get("targets", [])]
    return spark.createDataFrame(rows, "collection string, tag string, depth int, url string, description string")


def seed_urls(lines: DataFrame, line: str = "value", pos: str = "pos") -> DataFrame:
    """pos, url: stripped, without blanks and comments, distinct in order."""
    rows = lines.select(F.col(pos).alias("pos"), strip(F.col(line)).alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    return first_of(rows, "url", "pos")


def sitemap_listing(sitemaps: DataFrame, xml: str = "xml", at: str = "url", seed: str = "seed") -> DataFrame:
    """seed, url: page addresses of stored sitemaps (address, text), an index's sitemaps followed one level; a sitemap that an index names and that
    isn't stored, gives nothing. Addresses are under the seed, not skipped, distinct. Only sitemaps that no index names are entered by themselves."""
    locs = lambda path: F.xpath(F.col(xml), F.lit(path))
    named = sitemaps.select(seed, F.explode(locs("//*[local-name()='sitemap']/*[local-name()='loc']/text()")).alias("__sub")).select(seed, strip(F.col("__sub")).alias(at)).distinct()
    plain = sitemaps.filter(F.size(locs("//*[local-name()='sitemap']")) == 0)
    entered = plain.join(named.select(at).distinct(), at, "left_anti").select(seed, xml)
    followed = plain.select(at, xml).join(named, at).select(seed, xml)
    return sitemap_urls(entered.unionByName(followed), xml, seed)


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml", seed: str = "seed") -> DataFrame:
    """seed, url: page addresses under the seed that aren't skipped, distinct. An index's nested sitemaps are addresses here too."""
    locs = sitemaps.select(seed, F.explode(F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))).alias("url"))
    return locs.select(seed, defragment(strip(F.col("url"))).alias("url")).filter(under_seed(F.col("url"), F.col(seed)) & ~skipped_url(F.col("url"))).distinct()


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """id, title, summary of an Atom feed's entries."""
    x = lambda e: F.xpath(F.col(xml), F.lit(f"//*[local-name()='entry']/*[local-name()='{e}']/text()"))
    rows = feeds.select(F.explode(F.arrays_zip(x("id").alias("id"), x("title").alias("title"), x("summary").alias("summary"))).alias("e"))
    return rows.select("e.id", squeeze(F.col("e.title")).alias("title"), squeeze(F.col("e.summary")).alias("summary"))


def manifests(rows: DataFrame, column: str = "value") -> DataFrame:
    """Manifests from JSON text; what can't be parsed is an empty one."""
    return rows.select(F.from_json(F.col(column), MANIFEST, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")


def qa_dataset(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Questions with their relevant ids; ``most``: the first ones by place in the file."""
    rows = spark.read.schema(QA).json(path).withColumn("query_id", F.xxhash64("query", "collection"))
    if most is None:
        return rows
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]  # within a block rows come in order
    return rows.select("*", *[c.alias(f"__p{k}") for k, c in enumerate(place)]).orderBy("__p0", "__p1", "__p2").limit(most).drop("__p0", "__p1", "__p2")


def edges_of(rows: DataFrame, src: str, dst: str, pos: str | None = None) -> DataFrame:
    """src, dst, pos of a stored citation table; without a position references go by their id. Null ends and self-citations are dropped."""
    kept = rows.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    return kept.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(pos or dst).alias("pos"))


def already_there(length: Column, least: int = 10_000) -> Column:
    """A file of over ``least`` bytes counts as downloaded."""
    return F.coalesce(length > least, F.lit(False))


def web_results(answer: Column, most: int) -> Column:
    """array<struct<title,url,snippet>>: the first results of a metasearch answer."""
    got = F.from_json(answer, "results array<struct<title:string,url:string,content:string>>")["results"]
    return F.transform(F.slice(F.coalesce(got, F.array().cast("array<struct<title:string,url:string,content:string>>")), 1, most), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["content"].alias("snippet")))


def result_text(results: Column) -> Column:
    """Results as numbered lines of text, as a tool gives them to a model."""
    line = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("")), F.lit("\n"), F.coalesce(r["url"], F.lit("")), F.lit("\n"), F.coalesce(r["snippet"], F.lit("")))
    return F.array_join(F.transform(results, line), "\n\n")


_VECTOR = "struct<indices:array<bigint>,values:array<double>>"


def sparse_vectors(answer: Column) -> Column:
    """array<struct<indices,values>> of an encoder's answer, in either of its shapes: items that hold a sparse vector each, or embeddings."""
    got = F.from_json(answer, f"items array<struct<sparse:{_VECTOR}>>, embeddings array<{_VECTOR}>")
    return F.coalesce(F.transform(got["items"], lambda x: x["sparse"]), got["embeddings"], F.array().cast(f"array<{_VECTOR}>"))


def dense_vectors(answer: Column) -> Column:
    """array<array<float>> of an encoder's answer, in order of the index that each vector carries."""
    got = F.from_json(answer, "data array<struct<index:int,embedding:array<float>>>")["data"]
    ordered = F.array_sort(F.transform(got, lambda x: F.struct(x["index"].alias("index"), x["embedding"].alias("embedding"))))
    return F.coalesce(F.transform(ordered, lambda x: x["embedding"]), F.array().cast("array<array<float>>"))


def parse_scores(c: Column, n: int) -> Column:
    """A reranker's JSON answer, [{index, score}] or [score], as n scores; missing ones are 0."""
    pairs, flat = F.from_json(c, "array<struct<index:int,score:double>>"), F.from_json(c, "array<double>")
    at = lambda i: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["index"] == i), F.lit(1))["score"], F.try_element_at(flat, i.cast("int") + 1), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def page_accepted(status: Column, content_type: Column) -> Column:
    return (status == 200) & F.coalesce(F.lower(content_type).rlike("html|text"), F.lit(False))
