"""Link and citation graphs: breadth-first levels and expansions that go on where they stopped, top references of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import new_scratch_path

# Where a reference can be had, in order of preference.
SOURCES = ("arxiv", "unpaywall", "none")


def levels(edges: DataFrame, seeds: DataFrame, depth: int = -1, src: str = "src", dst: str = "dst", path: str | None = None) -> DataFrame:
    """node, level: each node at the level it is first reached. depth -1: until nothing new comes, however many levels; 0: seeds alone.

    A level is a table in a folder of its own under ``path`` (None: a scratch folder), which counts as complete once Spark has written its mark, by one commit.
    A run that finds complete levels goes on after them, so one that was killed ends as if it hadn't been; whoever gives a path answers for the
    seeds and edges being the same. The edges are written once, for all levels to read. Each level is one join of the one before with the edges, and one anti-join with those so far.
    """
    spark = edges.sparkSession
    root = (path or new_scratch_path(spark, "levels")).rstrip("/")
    edges = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    if not _complete(spark, f"{root}/edges"):
        edges.write.mode("overwrite").parquet(f"{root}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{root}/edges")
    first = seeds.select(F.col(seeds.columns[0]).alias("node")).dropna().distinct()
    at = lambda level: f"{root}/level={level}"
    read = lambda *some: spark.read.schema(first.schema).parquet(*[at(k) for k in some])
    level = 0
    while True:
        if not _complete(spark, at(level)):
            if level == 0:
                found = first
            else:
                found = read(level - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(read(*range(level)), "node", "left_anti")
            found.write.mode("overwrite").parquet(at(level))
        if level == depth or (depth < 0 and read(level).isEmpty()):
            break
        level += 1
    return spark.read.schema(StructType([*first.schema.fields, StructField("level", IntegerType())])).option("basePath", root).parquet(*[at(k) for k in range(level + 1)])


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def expand(papers: DataFrame, references: DataFrame, path: str, depth: int = 3, json_only: bool = False, most: int = 10) -> DataFrame:
    """level, source, node, rank, downloaded: the citations of papers (their first column) level by level. references: src, dst, citation_count, downloaded. Level n has
    the ``most`` most cited references of each paper of its frontier that wasn't a source before; the next frontier is what of these was downloaded. With
    ``json_only`` nothing is downloaded beyond level 2, so a third level is left out.

    Every level is a table under ``path`` with Spark's mark of completion, so a killed run goes on after the last complete level.
    """
    spark = papers.sparkSession
    refs = references.select("src", "dst", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce("downloaded", F.lit(False)).alias("downloaded")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    kind = refs.schema["dst"].dataType.simpleString()
    schema = f"source {kind}, node {kind}, rank int, downloaded boolean"
    at = lambda level: f"{path.rstrip('/')}/level={level}"
    frontier = papers.select(F.col(papers.columns[0]).alias("source")).dropna().distinct()
    done = 0
    for level in range(1, (min(depth, 2) if json_only else depth) + 1):
        if not _complete(spark, at(level)):
            best = top_references(refs.dropDuplicates(["src", "dst"]).join(frontier, F.col("src") == F.col("source"), "left_semi"), most, pos="dst")
            best.select(F.col("src").alias("source"), F.col("dst").alias("node"), "rank", "downloaded").write.mode("overwrite").parquet(at(level))
        done = level
        seen = papers.select(F.col(papers.columns[0]).alias("source")).unionByName(spark.read.schema(schema).parquet(*[at(k) for k in range(1, level + 1)]).select("source"))
        frontier = spark.read.schema(schema).parquet(at(level)).filter("downloaded").select(F.col("node").alias("source")).distinct().join(seen, "source", "left_anti")
    if not done:
        return spark.createDataFrame([], f"{schema}, level int")
    return spark.read.schema(f"{schema}, level int").option("basePath", path).parquet(*[at(k) for k in range(1, done + 1)])


def top_references(refs: DataFrame, n: int, source: str = "src", cites: str = "citation_count", pos: str = "pos", least: int = 0) -> DataFrame:
    """Each source's n most cited references with ``least`` citations (0: any), ties in the order given; rank from 1."""
    rows = refs.filter(F.col(cites) >= least) if least > 0 else refs
    w = Window.partitionBy(source).orderBy(F.desc(cites), pos)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def availability(arxiv_id: Column, oa_url: Column, doi: Column, found_url: Column) -> Column:
    """Where the text is: a paper id, an open-access URL, a URL that a lookup by DOI found, or nowhere."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(has(arxiv_id), SOURCES[0]).when(has(oa_url) | (has(doi) & has(found_url)), SOURCES[1]).otherwise(SOURCES[2])


def normalise_reference(title: Column, authors: Column, abstract: Column, count: Column) -> list[Column]:
    """title, authors (ten at most), abstract (500 characters), citation_count (0 if unknown)."""
    return [F.coalesce(title, F.lit("")).alias("title"), F.slice(F.coalesce(authors, F.array().cast("array<string>")), 1, 10).alias("authors"), F.left(F.coalesce(abstract, F.lit("")), F.lit(500)).alias("abstract"), F.coalesce(count, F.lit(0)).alias("citation_count")]


def valid_reference(title: Column, ref_id: Column, source_id: Column) -> Column:
    """A title, and not the source itself."""
    return F.coalesce(title != "", F.lit(False)) & ~F.coalesce(ref_id == source_id, F.lit(False))


def manifest_rows(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Manifests to be written: of each source (source, level, title) the references (source, rank, title, dst, citation_count, availability, downloaded, ingested,
    collection) in order of rank, all of them, with ``selected`` for those that were kept."""
    c = F.col
    ref = F.struct(
        "rank", c("title").alias("title"), c("dst").cast("string").alias("arxiv_id"), c("citation_count").cast("int").alias("citation_count"), "availability", "downloaded", "ingested", "collection", "selected",
    )
    listed = refs.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(ref)), lambda r: r.dropFields("rank")).alias("references"))
    none = F.array().cast(listed.schema["references"].dataType)
    joined = sources.join(listed, "source", "left")
    return joined.select(F.struct(c("source").cast("string").alias("arxiv_id"), "title").alias("source"), "level", F.coalesce("references", none).alias("references"))


def manifest_summary(manifests: DataFrame) -> DataFrame:
    """By level: manifests, references, downloaded, ingested, without access; manifests(level, references array<struct<…>>)."""
    r = manifests.select("level", F.explode_outer("references").alias("r"))
    counts = r.groupBy("level").agg(
        F.count("r").alias("n_references"), F.count_if(F.col("r.downloaded")).alias("downloaded"), F.count_if(F.col("r.ingested")).alias("ingested"), F.count_if(F.col("r.availability") == "none").alias("no_access")
    )
    return manifests.groupBy("level").agg(F.count(F.lit(1)).alias("n_manifests")).join(counts, "level")
