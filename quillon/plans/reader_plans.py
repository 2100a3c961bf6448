"""Queries of readers, writers and small column functions: the driver tables are written in the forms that these read, and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as tx
from ..functions.vectors import sparse_sorted
from ..operators import chunking, cluster, context, evaluate, graph, store
from ..sources import paged, readers, sinks
from .registry import SQL_STRIP, SQL_WORDS, query, scratch, table

_LINE = f"replace({SQL_STRIP.format('text')}, chr(10), ' ')"


@query(f"""
SELECT 'p' || doc_id AS arxiv_id, (1990 + doc_id % 35)::INTEGER AS year, length({_LINE})::INTEGER AS n, CASE WHEN doc_id % 2 = 0 THEN 'J' || doc_id END AS journal_ref
FROM documents WHERE doc_id % 17 <> 0 AND 1990 + doc_id % 35 >= 2000 AND length({_LINE}) > 50""")
def papers_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of metadata, with both spellings of fields, blank and malformed lines, and lines without an id; read, cleaned and filtered."""
    i, path = F.col("doc_id"), scratch(spark, "metadata")
    name, none = F.concat(F.lit("p"), i.cast("string")), F.lit(None).cast("string")
    journal = F.when(i % 2 == 0, F.concat(F.lit("J"), i.cast("string")))
    row = F.struct(
        F.when((i % 17 != 0) & (i % 3 == 0), name).alias("id"), F.when(i % 17 == 0, none).when(i % 3 == 0, F.lit("")).otherwise(name).alias("arxiv_id"), F.lit(" a\nb ").alias("title"), F.col("text").alias("abstract"), F.lit("A,  B").alias("authors"),
        F.concat((F.lit(1990) + i % 35).cast("string"), F.lit("-01-31")).alias("update_date"), F.when(i % 4 == 0, journal).alias("journal-ref"), F.when(i % 4 != 0, journal).alias("journal_ref"),
    )
    lines = table(spark, d, "documents").select(F.explode(F.array(F.to_json(row), F.when(i % 19 == 0, F.lit("not json")).otherwise(F.lit("")))).alias("value"))
    lines.write.text(path)
    papers = readers.long_abstracts(readers.loadable(readers.normalised_papers(readers.raw_metadata(spark, path))))
    return papers.select("arxiv_id", "year", F.length("abstract").alias("n"), "journal_ref")


@query("SELECT source, count(*) AS every, count(*) FILTER (n_chars > 1000) AS kept FROM documents GROUP BY source")
def dual_lines(spark: SparkSession, d: str) -> DataFrame:
    """All documents and the long ones as two sets of lines, counted again."""
    every, some = scratch(spark, "all"), scratch(spark, "some")
    sinks.dual_json(table(spark, d, "documents").select("doc_id", "source", "n_chars"), every, some, F.col("n_chars") > 1000)
    count = lambda path, name: spark.read.schema("source string").json(path).groupBy("source").agg(F.count(F.lit(1)).alias(name))
    return count(every, "every").join(count(some, "kept"), "source", "left").select("source", "every", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95, count(*) AS n, (SELECT count(*) FROM events WHERE value IS NOT NULL) AS rows FROM events WHERE value IS NOT NULL GROUP BY event_type")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of latencies: metrics and single rows as JSON, read again."""
    path, events = scratch(spark, "report"), table(spark, d, "events").filter("value IS NOT NULL").select("event_id", "event_type", "value")
    sinks.report(evaluate.p95(events, "value", ["event_type"]), events, path)
    metrics = spark.read.schema("event_type string, p95 double, n long").json(f"{path}/metrics")
    rows = spark.read.schema("event_id long").json(f"{path}/queries").agg(F.count(F.lit(1)).alias("rows"))
    return metrics.join(F.broadcast(rows))  # one row


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ids appended to a progress file in two batches, one of them again; what isn't in it is still to be done."""
    path, ids = scratch(spark, "progress"), table(spark, d, "documents").select("doc_id")
    for part in ("doc_id % 3 = 0 AND doc_id % 2 = 0", "doc_id % 3 = 0 AND doc_id % 2 = 1", "doc_id % 6 = 0"):
        sinks.append_progress(ids.filter(part), path)
    return store.not_done(ids, readers.progress(spark, path).select(F.col("id").cast("long").alias("doc_id")), "doc_id")


@query("SELECT 'x' || doc_id AS id FROM documents WHERE doc_id % 5 <> 0")
def listed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ids with remarks, comments and blank lines."""
    i, path = F.col("doc_id"), scratch(spark, "ids")
    line = F.when(i % 10 == 0, F.lit("  # not this")).when(i % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  x"), i.cast("string"), F.lit("\tand a remark")))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return readers.id_list(spark, path)


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def collection_scan(spark: SparkSession, d: str) -> DataFrame:
    """One collection of many, without its vectors."""
    path = scratch(spark, "collections")
    table(spark, d, "embeddings").withColumn("collection", F.concat(F.lit("c"), F.col("label").cast("string"))).write.partitionBy("collection").parquet(path)
    return readers.scan_collection(spark, path, "c3", ["vec_id", "label"])


@query("SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def paged_scroll(spark: SparkSession, d: str) -> DataFrame:
    """All points as pages with a cursor, read back in parallel."""
    path = scratch(spark, "pages")
    paged.write_pages(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding"), path)
    paged.register(spark)
    rows = spark.read.format(paged.FORMAT).schema("id long, label int, embedding array<double>").load(path)
    return rows.select("id", "label", F.round(F.element_at("embedding", 1).cast("float").cast("double"), 6).alias("first"))


_REFS = "SELECT l_suppkey AS source, l_partkey AS dst, count(*) AS citation_count FROM lineitem GROUP BY ALL"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY citation_count DESC, dst) AS rank FROM ({_REFS})),
m AS (SELECT s_suppkey % 3 AS level, count(*) AS n_manifests FROM supplier GROUP BY 1)
SELECT m.level::INTEGER AS level, any_value(n_manifests) AS n_manifests, count(r.dst) AS n_references, count(*) FILTER (rank <= 5) AS downloaded, count(*) FILTER (rank <= 5 AND dst % 2 = 0) AS ingested, count(*) FILTER (dst % 4 = 3) AS no_access
FROM m LEFT JOIN r ON r.source % 3 = m.level GROUP BY m.level""")
def manifest_levels(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of each supplier's references, all of them with a mark for those that were kept, written as JSON, read again and summed up by level."""
    refs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("citation_count"))
    ranked = graph.top_references(refs, 1 << 30, source="source", pos="dst")
    i, kept = F.col("dst"), F.col("rank") <= 5
    where = graph.availability(F.when(i % 4 == 0, "a"), F.when(i % 4 < 3, "u"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = ranked.select("source", "rank", F.concat(F.lit("t"), i.cast("string")).alias("title"), "dst", "citation_count", where.alias("availability"), kept.alias("downloaded"), (kept & (i % 2 == 0)).alias("ingested"), F.lit("c").alias("collection"), kept.alias("selected"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 3).cast("int").alias("level"), F.col("s_name").alias("title"))
    path = scratch(spark, "manifests")
    graph.manifest_rows(sources, rows).write.json(path)
    return graph.manifest_summary(readers.manifests(spark.read.text(path)))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 1")
def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a fetch: those that were found and are text."""
    i = F.col("page_id")
    status, kind = F.when(i % 3 == 0, 404).otherwise(200), F.when(i % 4 == 0, "Text/HTML; charset=utf-8").when(i % 4 == 2, "text/plain").when(i % 8 == 3, "application/xhtml+xml").when(i % 8 == 7, "TEXT/css").when(i % 8 == 5, F.lit("image/png"))
    return table(spark, d, "pages").filter(readers.page_accepted(status, kind)).select("page_id", "url")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND text <> '' AND text NOT LIKE '[%'")
def captions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as captions: empty ones, and marks in brackets, are none."""
    caption = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").filter(cluster.caption_valid(caption)).select("conv_id", "turn")


@query("SELECT p_brand, min(p_size)::DOUBLE AS x0, min(p_retailprice) AS y0, max(p_size)::DOUBLE + 1 AS x1, max(p_retailprice) + 2 AS y1 FROM part GROUP BY p_brand HAVING count(*) >= 6")
def drawing_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around all drawings of a page that has six of them."""
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return cluster.bounding_box(table(spark, d, "part").select("p_brand", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 2).alias("y1")), ["p_brand"])


_TITLED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN '  ' END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS abstract, CASE WHEN doc_id % 5 = 0 THEN 'own ' || doc_id WHEN doc_id % 5 = 1 THEN ' ' END AS own FROM documents"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    number = i.cast("string")
    title, own = F.when(i % 4 == 0, F.concat(F.lit("T"), number)).when(i % 4 == 1, F.lit("  ")), F.when(i % 5 == 0, F.concat(F.lit("own "), number)).when(i % 5 == 1, F.lit(" "))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.when(i % 3 != 0, F.col("text")).alias("abstract"), own.alias("own"))


@query(f"SELECT doc_id, md5(CASE WHEN trim(coalesce(title, '')) <> '' THEN title || chr(10) || coalesce(abstract, '') ELSE coalesce(abstract, '') END) AS embed_md5, md5(CASE WHEN trim(coalesce(own, '')) <> '' THEN own WHEN {SQL_STRIP.format('concat_ws(chr(10), title, abstract)')} <> '' THEN concat_ws(chr(10), title, abstract) ELSE 'empty' END) AS backfill_md5 FROM ({_TITLED})")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """What vectors are made of: title and abstract, and what a backfill falls back to."""
    c = F.col
    return _titled(spark, d).select("doc_id", F.md5(context.embed_text(c("title"), c("abstract"))).alias("embed_md5"), F.md5(context.backfill_text(c("own"), c("title"), c("abstract"))).alias("backfill_md5"))


@query(f"SELECT doc_id FROM ({_TITLED}) WHERE doc_id % 7 <> 0 AND (trim(coalesce(title, '')) <> '' OR {SQL_STRIP.format(chr(99) + 'oalesce(abstract, ' + chr(39) + chr(39) + ')')} <> '')")
def backfill_rows(spark: SparkSession, d: str) -> DataFrame:
    """Points that have no sparse vector yet, and text to make one of."""
    rows = _titled(spark, d).withColumn("indices", F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(1))))
    return rows.filter(store.lacks_sparse(F.col("indices")) & store.has_text(F.col("title"), F.col("abstract"))).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN [] ELSE ['A' || doc_id, 'B. C', lang] END AS authors FROM documents WHERE lang IS NOT NULL")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """Delimited names as lists."""
    i = F.col("doc_id")
    names = F.when(i % 12 == 0, F.lit(" , ,")).when(i % 6 != 0, F.concat(F.lit(" A"), i.cast("string"), F.lit(",B. C ,, "), F.col("lang"), F.lit("\t")))
    return table(spark, d, "documents").filter("lang IS NOT NULL").select("doc_id", tx.as_list(names, ",").alias("authors"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'i' || doc_id ELSE 'q' || doc_id END AS arxiv_id, coalesce(lang, '') AS categories, '' AS title, CASE WHEN doc_id % 2 = 0 THEN doc_id::INTEGER ELSE -1 END AS year, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS score, CASE WHEN doc_id % 5 = 0 THEN 'figure' ELSE 'abstract' END AS type FROM documents")
def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Points of different shapes as hits of one shape."""
    i = F.col("doc_id")
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    rows = table(spark, d, "documents").select(
        F.when(i % 3 == 0, name("a")).when(i % 3 == 1, F.lit(" ")).alias("arxiv_id"), F.when(i % 3 == 1, name("i")).alias("id"), name("q").alias("point_id"), F.col("lang").alias("categories"), F.when(i % 2 == 0, i).alias("year"),
        F.when(i % 2 == 0, 0.5).alias("score"), F.when(i % 5 == 0, "figure").when(i % 5 == 1, "").alias("type"),
    )
    return context.hit_columns(rows).select("arxiv_id", "categories", "title", F.coalesce("year", F.lit(-1)).alias("year"), "score", "type")


@query("SELECT vec_id, [label::BIGINT, label + 5::BIGINT, label + 900::BIGINT] AS indices, [2.0, 3.0, 1.0]::DOUBLE[] AS vals FROM embeddings")
def sorted_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by index, in order of the index as a number."""
    at = F.col("label").cast("long")
    weights = sparse_sorted(F.create_map((at + 900).cast("string"), F.lit(1.0), at.cast("string"), F.lit(2.0), (at + 5).cast("string"), F.lit(3.0)))
    return table(spark, d, "embeddings").select("vec_id", weights["index"].alias("indices"), weights["value"].alias("vals"))


@query("SELECT doc_id, '2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS paper FROM documents")
def url_paper_ids(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")
    return table(spark, d, "documents").select("doc_id", tx.paper_id_of_url(F.concat(F.lit("http://example.org/abs/2101."), number, F.when(F.col("doc_id") % 2 == 0, "v3").otherwise(""))).alias("paper"))


@query("SELECT 'http://x/' || doc_id AS id, 'T ' || lang AS title, 'of ' || source AS summary FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries of feeds, one a source, read from the XML."""
    entry = F.concat(F.lit("<entry><id>http://x/"), F.col("doc_id").cast("string"), F.lit("</id><title>\n T   "), F.col("lang"), F.lit(" </title><summary>of\n"), F.col("source"), F.lit("</summary></entry>"))
    rows = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(F.concat_ws("", F.collect_list(entry)).alias("x"))
    return readers.atom_entries(rows.select(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), "x", F.lit("</feed>")).alias("xml")))


_CHUNKS = f"SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 85.0)::BIGINT) + 1)) AS i FROM (SELECT doc_id, len({SQL_WORDS.format('text')}) AS n FROM documents) WHERE n > 0"


@query(f"SELECT c.doc_id, c.i::INTEGER AS chunk_idx, least(100, n - i * 85)::INTEGER AS token_count, e.label, coalesce(q.quality, -1)::INTEGER AS quality FROM ({_CHUNKS}) c JOIN embeddings e ON e.vec_id = c.doc_id LEFT JOIN labels q ON q.doc_id = c.doc_id AND c.i = 0")
def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with what is known of their document and, for its first chunk, of the chunk: joins by (doc_id, chunk_idx), not by place."""
    chunks = chunking.chunk_flat(table(spark, d, "documents"), 100, 15).select("doc_id", "chunk_idx", "token_count")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    known = table(spark, d, "labels").select("doc_id", F.lit(0).alias("chunk_idx"), "quality")
    return chunks.join(vectors, "doc_id").join(known, ["doc_id", "chunk_idx"], "left").select("doc_id", "chunk_idx", "token_count", "label", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT 'c' || label AS collection, count(*) AS n, count(DISTINCT vec_id) AS ids, 1::BIGINT AS files, 13::BIGINT AS columns, sum(label % 2)::BIGINT AS listed FROM embeddings WHERE vec_id % 10 <> 9 GROUP BY label")
def exported_files(spark: SparkSession, d: str) -> DataFrame:
    """Points of the right length in one file for each collection, with the thirteen columns of an export."""
    path, i = scratch(spark, "export"), F.col("vec_id")
    e = table(spark, d, "embeddings")
    points = e.select(
        i.cast("string").alias("arxiv_id"), F.when(F.col("label") % 2 == 1, "X").alias("categories"), F.lit("A, B").alias("authors"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
        F.when(i % 10 == 9, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("dense_embedding"), F.array(i).alias("sparse_indices"), F.array(F.lit(1.0)).alias("sparse_values"),
    )
    store.export_files(points, path, 64)
    rows = spark.read.parquet(path)
    return rows.withColumn("file", F.input_file_name()).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("arxiv_id").alias("ids"), F.count_distinct("file").alias("files"), F.lit(len(rows.columns)).cast("long").alias("columns"), F.sum(F.size("categories")).cast("long").alias("listed")
    )


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """A collection's snapshot, restored under another name once each of its files has the bytes and the hash that its manifest says."""
    s, to = store.Store(spark, scratch(spark, "store"), "doc_id", buckets=4), scratch(spark, "snapshot")
    s.write("c", table(spark, d, "documents").select("doc_id", "lang"))
    manifest = s.snapshot("c", to)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(to).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("now"))
    sound = files.join(manifest, "file", "full").agg(F.bool_and(F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("sound"))
    s.write("again", spark.read.parquet(to))
    return s.read("again").join(F.broadcast(sound.filter("sound"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(lang, '-') AS collection, 'success' AS outcome, count(*) AS rows FROM documents GROUP BY 1")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What a re-ingestion would write, without writing it."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"))
    s = store.Store(spark, scratch(spark, "store"), "doc_id")
    names = [r.lang for r in docs.select("lang").distinct().collect()]
    told = s.reingest(names, lambda name: docs.filter(F.col("lang") == name), scratch(spark, "snapshots"), dry_run=True)
    return told.filter(F.lit(s.collections() == [])).select("collection", "outcome", "rows")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(text) >= 500 THEN 1 WHEN doc_id % 2 = 0 AND length(text) >= 100 THEN 2 ELSE 0 END::INTEGER AS tier, CASE WHEN doc_id % 3 = 0 AND length(text) >= 500 THEN length(text) WHEN doc_id % 2 = 0 AND length(text) >= 100 THEN length(text) ELSE 0 END::INTEGER AS chars FROM documents")
def extraction_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The first of two extractions that gives enough text; else none."""
    i = F.col("doc_id")
    tier = lambda where, n: F.when(where, F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("text"), F.lit(n).alias("page_num"))))
    got = models.extraction_cascade([(tier(i % 3 == 0, 1), 500), (tier(i % 2 == 0, 2), 100)])
    rows = table(spark, d, "documents").select("doc_id", got.alias("s"))
    return rows.select("doc_id", F.coalesce(F.try_element_at("s", F.lit(1))["page_num"], F.lit(0)).alias("tier"), F.coalesce(F.length(F.try_element_at("s", F.lit(1))["text"]), F.lit(0)).alias("chars"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN [0.0, 0.5, 0.25]::DOUBLE[] WHEN vec_id % 3 = 1 THEN [label::DOUBLE, 0.5, 0.0]::DOUBLE[] ELSE [0.0, 0.0, 0.0]::DOUBLE[] END AS scores FROM embeddings")
def parsed_scores(spark: SparkSession, d: str) -> DataFrame:
    """A reranker's answers in both shapes, and one that is no JSON."""
    i = F.col("vec_id")
    answer = F.when(i % 3 == 0, F.lit('[{"index": 2, "score": 0.25}, {"index": 1, "score": 0.5}]')).when(i % 3 == 1, F.concat(F.lit("["), F.col("label").cast("string"), F.lit(", 0.5]"))).otherwise(F.lit("sorry"))
    return table(spark, d, "embeddings").select("vec_id", readers.parse_scores(answer, 3).alias("scores"))


@query("SELECT page_id, '[1] P' || page_id || chr(10) || 'u1' || chr(10) || 's' || chr(10) || chr(10) || '[2] ' || chr(10) || url || chr(10) AS answer FROM pages")
def web_answers(spark: SparkSession, d: str) -> DataFrame:
    """The first two results of a metasearch, as a tool tells them."""
    one = F.struct(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), F.lit("u1").alias("url"), F.lit("s").alias("content"))
    two = F.struct(F.lit(None).cast("string").alias("title"), F.col("url").alias("url"), F.lit(None).cast("string").alias("content"))
    got = F.to_json(F.struct(F.array(one, two, one).alias("results")))
    return table(spark, d, "pages").select("page_id", readers.result_text(readers.web_results(got, 2)).alias("answer"))


@query("SELECT text AS query, [item_id::VARCHAR, 'x'] AS relevant_ids, 'documents' AS collection FROM benchmark")
def question_set(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their relevant ids, as lines of JSON."""
    path = scratch(spark, "questions")
    table(spark, d, "benchmark").select(F.col("text").alias("query"), F.array(F.col("item_id").cast("string"), F.lit("x")).alias("relevant_ids"), F.lit("documents").alias("collection")).write.json(path)
    return readers.qa_dataset(spark, path).select("query", "relevant_ids", "collection")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::INTEGER ELSE 0 END AS year FROM orders")
def pdf_years(spark: SparkSession, d: str) -> DataFrame:
    """Years of creation dates as PDF files have them."""
    date = F.when(F.col("o_orderkey") % 3 == 0, F.lit("D:n.d.")).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000Z")))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(tx.pdf_year(date), F.lit(0)).alias("year"))


_IMAGES = "text || ' ![a b](data:image/png;base64,AAAA) and ' || repeat('Qz09', 30) || '== end'"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({_IMAGES}, '!\\[[^\\]]*\\]\\(data:image/[^)]+\\)', '[image]', 'g'), '[A-Za-z0-9+/]{{100,}}={{0,2}}', '', 'g')) AS text_md5 FROM documents")
def images_removed(spark: SparkSession, d: str) -> DataFrame:
    """Texts without images that were written into them."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.strip_inline_images(F.expr(_IMAGES))).alias("text_md5"))


@query(f"SELECT doc_id, md5({SQL_STRIP.format(chr(34) + 't' + chr(34))}) AS text_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\. ', '.' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM documents)")
def blank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two blank lines in a row at most."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.limit_blank_lines(F.regexp_replace("text", r"\. ", ".\n\n\n\n\n"))).alias("text_md5"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'topic_' || turn ELSE left(t, 60) END AS topic FROM (SELECT conv_id, turn, regexp_replace(role || ' of ' || conv_id || repeat(' x', 40), '^\\s+', '') AS t FROM conversations)")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    """A model's names for topics, without label and quotes; where it gives none, a number."""
    n = F.col("turn")
    said = F.when(n % 3 == 0, F.lit(' "" ')).otherwise(F.concat(F.lit(' Topic : "'), F.col("role"), F.lit(" of "), F.col("conv_id").cast("string"), F.repeat(F.lit(" x"), 40), F.lit("'\n")))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.clean_topic(said, F.concat(F.lit("topic_"), n.cast("string"))).alias("topic"))


@query("SELECT doc_id, md5('Use this:' || chr(10) || coalesce(CASE WHEN doc_id % 4 <> 0 THEN text END, '') || chr(10) || 'and answer ' || doc_id || '.') AS prompt_md5 FROM documents")
def filled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template with its marks filled, empty where there is nothing."""
    i = F.col("doc_id")
    made = context.fill("Use this:\n{context}\nand answer {number}.", context=F.when(i % 4 != 0, F.col("text")), number=i.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.md5(made).alias("prompt_md5"))
