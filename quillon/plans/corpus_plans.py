"""Queries of text and HTML functions, chunking, storage, graphs, caching, status and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as pages_html
from ..functions import text as tx
from ..operators import cache, chunking, cluster, context, crawl, graph, hierarchy, store
from ..sources import readers
from ..streaming.incremental import ingest_files
from .registry import SQL_STRIP, SQL_WORDS, query, scratch, table

_WINDOWS = "SELECT doc_id, w, len(w) AS n, unnest(range(0, {last} + 1)) AS i FROM (SELECT doc_id, {words} AS w FROM {source}) WHERE len(w) > 0"
_CHUNK = "SELECT doc_id, i::INTEGER AS chunk_idx, least({size}, n - i * {step})::INTEGER AS token_count, md5(array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ')) AS chunk_md5 FROM ({windows}) WHERE least({size}, n - i * {step}) >= {least}"
_FLAT = _WINDOWS.format(last="greatest(0, ceil((len(w) - 100) / 85.0)::BIGINT)", words=SQL_WORDS.format("text"), source="documents")
_CITED = _WINDOWS.format(last="floor((len(w) - 1) / 85.0)::BIGINT", words=SQL_WORDS.format("text"), source="documents")


@query(_CHUNK.format(size=100, step=85, least=1, windows=_FLAT))
def chunk_flat(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_flat(table(spark, d, "documents"), 100, 15).select("doc_id", "chunk_idx", "token_count", F.md5("chunk_text").alias("chunk_md5"))


@query(_CHUNK.format(size=100, step=85, least=20, windows=_CITED))
def chunk_citation(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_flat(table(spark, d, "documents"), 100, 15, early_stop=False, least=20).select("doc_id", "chunk_idx", "token_count", F.md5("chunk_text").alias("chunk_md5"))


_MARKDOWN = "'# Part one' || chr(10) || text || chr(10) || '## Part two' || chr(10) || chr(10) || left(text, 200)"


@query(rf"""
WITH d AS (SELECT doc_id, string_split({_MARKDOWN}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
m AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM l),
s AS (SELECT doc_id, sec, coalesce(max(CASE WHEN starts_with(line, '#') THEN {SQL_STRIP.format("regexp_replace(line, '^#+', '')")} END), '') AS heading,
      coalesce(string_agg(CASE WHEN NOT starts_with(line, '#') THEN line END, chr(10) ORDER BY pos), '') AS body FROM m GROUP BY doc_id, sec),
w AS (SELECT doc_id, sec, heading, {SQL_WORDS.format("body")} AS w FROM s),
c AS (SELECT doc_id, sec, heading, w, len(w) AS n, unnest(range(0, greatest(0, ceil((len(w) - 120) / 100.0)::BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1)::INTEGER AS chunk_idx, heading, least(120, n - i * 100)::INTEGER AS token_count,
       md5(CASE WHEN i > 0 AND heading <> '' THEN heading || chr(10) || chr(10) ELSE '' END || array_to_string(list_slice(w, i * 100 + 1, i * 100 + 120), ' ')) AS chunk_md5 FROM c""")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# Part one\n"), F.col("text"), F.lit("\n## Part two\n\n"), F.left("text", F.lit(200)))
    sections = chunking.markdown_sections(table(spark, d, "documents").select("doc_id", text.alias("text")))
    return chunking.chunk_sections(sections, 120, 20).select("doc_id", "chunk_idx", "heading", "token_count", F.md5("chunk_text").alias("chunk_md5"))


@query(
    "SELECT doc_id, ('0x' || substr(sha256('doc::' || doc_id), 1, 15))::BIGINT AS long_id, regexp_replace(substr(sha256('doc::' || doc_id), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid_id, "
    "substr(md5(left(text, 60)), 1, 8) AS short_key FROM documents"
)
def chunk_point_id(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", tx.long_id(key).alias("long_id"), tx.uuid_id(key).alias("uuid_id"), tx.short_key(F.left("text", F.lit(60))).alias("short_key"))


_TITLE = r"regexp_replace(regexp_replace({0}, '(?i)\s*[|—–\-]\s*(documentation|docs|reference|guide|api|manual|wiki)\s*$', ''), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_TITLE.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?s)<title>(.*?)</title>' + chr(39) + ', 1) || ' + chr(39) + ' | Docs' + chr(39) + chr(41))} AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.clean_title(F.concat(tx.html_title(F.col("html")), F.lit(" | Docs"))).alias("title"))


@query("SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def html_h1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.html_h1(F.col("html")).alias("h1"))


_BARE = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _BARE = f"regexp_replace({_BARE}, '(?s)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_PLAIN = f"regexp_replace(regexp_replace({_BARE}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@query(rf"SELECT page_id, md5(regexp_replace(regexp_replace({_PLAIN}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("text_md5"))


@query()
def html_page(spark: SparkSession, d: str) -> DataFrame:
    """Parser tier; tested against literal pages."""
    rows = table(spark, d, "pages").select("page_id", pages_html.page_content(F.col("html")).alias("p"))
    return rows.select("page_id", tx.clean_title(F.col("p.title")).alias("title"), "p.section", "p.text")


@query("""SELECT page_id, generate_subscripts(l, 1)::INTEGER - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), lambda h: trim(h)), lambda h: h <> '') AS l FROM pages)""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(tx.links(F.col("html"))).alias("pos", "href"))


# a seed is a root, whose path has no version segment, so any segment is another version's
_OLD_AT = " OR ".join("(regexp_extract(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '" + p.replace("{", "{{").replace("}", "}}") + "') <> '')" for p in tx.VERSION_SEGMENTS)
_AUTHORITY = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


_TARGETS = f"""SELECT DISTINCT page_id, url, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || href, '#.*$', '') AS target
FROM (SELECT page_id, url, unnest(list_filter(list_transform(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), lambda h: trim(h)), lambda h: h <> '')) AS href FROM pages)
WHERE NOT ({" OR ".join(f"contains(lower(target), '{p}')" for p in tx.SKIPPED_URL_PARTS)})"""


@query(f"SELECT page_id, target FROM ({_TARGETS})")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Absolute, defragmented targets of links that aren't skipped. The stored pages' links begin with a slash, so SQL can join them; other forms are tested by
    literals."""
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(tx.links(F.col("html"))).alias("href"))
    joined = rows.select("page_id", tx.defragment(pages_html.join_url(F.col("url"), F.col("href"))).alias("target")).filter(F.col("target").isNotNull())
    return joined.filter(~tx.skipped_url(F.col("target"))).distinct()


_ROOT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || '/'"


@query(f"""
WITH p AS (SELECT *, regexp_replace(url, '#.*$', '') AS u, {_ROOT} AS seed FROM pages), s AS (SELECT DISTINCT seed FROM p),
z AS (SELECT seed, seed AS url FROM s UNION SELECT seed, u FROM p WHERE page_id % 2 = 0 AND NOT ({" OR ".join(f"contains(lower(u), '{x}')" for x in tx.SKIPPED_URL_PARTS)}) AND NOT ({_OLD_AT.format("u")})),
n AS (SELECT DISTINCT p.seed, t.target AS url FROM ({_TARGETS}) t JOIN p USING (page_id) JOIN z ON z.seed = p.seed AND z.url = p.u WHERE NOT ({_OLD_AT.format("t.target")}))
SELECT seed, url, 0::INTEGER AS level FROM z UNION ALL SELECT seed, url, 1 FROM n WHERE (seed, url) NOT IN (SELECT (seed, url) FROM z)""")
def crawl_sites(spark: SparkSession, d: str) -> DataFrame:
    """Every host crawled from its root, with half of its stored pages as further addresses, to depth 1."""
    pages = table(spark, d, "pages")
    seed = F.concat(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.lit("/"))
    rows = pages.select("page_id", "url", seed.alias("seed"))
    return crawl.crawl_sites(pages, rows.select("seed"), 1, rows.filter("page_id % 2 = 0").select("seed", "url"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.defragment(F.col("url")).alias("url"))


@query(f"SELECT {_AUTHORITY.format('url')} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(tx.url_authority(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, {_PATH.format('url')} AS path FROM pages")
def url_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.url_path(F.col("url")).alias("path"))


_SKIPPED = " OR ".join(f"contains(lower(u), '{p}')" for p in tx.SKIPPED_URL_PARTS)
_FAKED = "CASE page_id % 4 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '?download=1' ELSE url END"


@query(f"SELECT page_id, ({_SKIPPED}) AS skipped FROM (SELECT page_id, {_FAKED} AS u FROM pages)")
def url_skip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.skipped_url(F.expr(_FAKED)).alias("skipped"))


_SEED = "'https://' || split_part(split_part(url, '://', 2), '/', 1) || '/en/index.html'"


@query(f"SELECT page_id, ({_AUTHORITY.format('url')} = {_AUTHORITY.format('seed')} AND starts_with({_PATH.format('url')}, regexp_extract({_PATH.format('seed')}, '^(.*/)', 1))) AS under FROM (SELECT page_id, url, {_SEED} AS seed FROM pages)")
def url_same_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.expr(_SEED).alias("seed")).select("page_id", tx.under_seed(F.col("url"), F.col("seed")).alias("under"))


_VERSIONED = "CASE page_id % 5 WHEN 0 THEN 'https://d.org/v1.2.3/a' WHEN 1 THEN 'https://d.org/14/a' WHEN 2 THEN 'https://d.org/release_2.0/a' WHEN 3 THEN 'https://d.org/numpy-1.24/a' ELSE url || '/' END"
_OLD = " OR ".join(f"(regexp_extract({_PATH.format('u')}, '{p}') <> '' AND NOT contains('/v1.2.3/', regexp_extract({_PATH.format('u')}, '{p}')))" for p in tx.VERSION_SEGMENTS)


@query(f"SELECT page_id, ({_OLD}) AS old FROM (SELECT page_id, {_VERSIONED} AS u FROM pages)")
def url_old_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.old_version(F.expr(_VERSIONED), F.lit("https://d.org/v1.2.3/")).alias("old"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")
def whitespace_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("text_md5"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1")
def year_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(tx.year_of(F.col("o_orderdate").cast("string")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR year(o_orderdate) >= 1996")
def min_year(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n.d.")).otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", tx.year_of(day).alias("year")).filter("year IS NULL OR year >= 1996").select("o_orderkey")


@query(f"SELECT doc_id, length(t)::INTEGER AS n FROM (SELECT doc_id, replace({SQL_STRIP.format('text')}, chr(10), ' ') AS t FROM documents) WHERE length(t) > 50")
def abstract_filter(spark: SparkSession, d: str) -> DataFrame:
    """Over whole texts."""
    docs = table(spark, d, "documents").select("doc_id", tx.one_line(F.col("text")).alias("abstract"))
    return readers.long_abstracts(docs).select("doc_id", F.length("abstract").alias("n"))


_NEW = "SELECT doc_id + CASE WHEN doc_id % 6 = 0 THEN 1000000 ELSE 0 END AS doc_id, 'new' AS source, 1 AS batch FROM documents WHERE doc_id % 3 = 0"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 6 == 0, 1000000).otherwise(0)).alias("doc_id"), F.lit("new").alias("source"), F.lit(1).alias("batch"))
    return docs.select("doc_id", "source", F.lit(0).alias("batch")), new


@query(f"SELECT doc_id, source, batch FROM (SELECT doc_id, source, 0 AS batch FROM documents UNION ALL {_NEW}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_versions(spark, d), "doc_id")


@query(f"SELECT o.doc_id, coalesce(n.source, o.source) AS source, o.lang FROM documents o LEFT JOIN ({_NEW}) n USING (doc_id)")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    return store.partial_update(table(spark, d, "documents").select("doc_id", "source", "lang"), _versions(spark, d)[1], "doc_id", ["source"])


@query(f"WITH a AS (SELECT doc_id, source, batch FROM (SELECT doc_id, source, 0 AS batch FROM documents UNION ALL {_NEW}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1) SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id < 1000000 THEN 'patched' ELSE source END AS source, batch FROM a")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Create, write, upsert, partial update and read of a stored collection."""
    old, new = _versions(spark, d)
    s = store.Store(spark, scratch(spark, "store"), "doc_id")
    s.create("c", recreate=True)
    s.write("c", old)
    s.upsert("c", new)
    s.update("c", old.filter("doc_id % 5 = 0").select("doc_id", F.lit("patched").alias("source")), ["source"])
    return s.read("c")


_BATCHES = "SELECT doc_id, source, 0 AS batch FROM documents UNION ALL SELECT doc_id + 500000, 'second', 1 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'third', 2 FROM documents WHERE doc_id % 100 = 7 UNION ALL SELECT doc_id, 'late', 1 FROM documents WHERE doc_id % 50 = 7"


@query(f"SELECT doc_id, source, batch FROM ({_BATCHES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1")
def bucket_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection that takes new ids, replacements, and an older batch that comes late, each as parts of the buckets that its ids fall in."""
    docs, i = table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id")
    s = store.Store(spark, scratch(spark, "buckets"), "doc_id", buckets=8)
    s.upsert("c", docs.withColumn("batch", F.lit(0)))
    for rows, source, batch in ((docs.filter(i % 3 == 1).withColumn("doc_id", i + 500_000), "second", 1), (docs.filter(i % 100 == 7), "third", 2), (docs.filter(i % 50 == 7), "late", 1)):
        s.upsert("c", rows.select("doc_id", F.lit(source).alias("source"), F.lit(batch).alias("batch")))
    return s.read("c")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return store.not_done(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT x::INTEGER AS label, x NOT IN (SELECT label FROM embeddings) AS missing FROM range(0, 15) t(x)")
def missing_collections(spark: SparkSession, d: str) -> DataFrame:
    want, have = spark.range(15).select(F.col("id").cast("int").alias("label")), table(spark, d, "embeddings").select("label")
    return want.intersect(have).withColumn("missing", F.lit(False)).unionByName(want.subtract(have).withColumn("missing", F.lit(True)))


@query("SELECT coalesce(h.source, w.source) AS source, coalesce(h.points, 0) AS points, h.points IS NULL AS missing FROM (SELECT source, count(*) AS points FROM documents GROUP BY source) h FULL JOIN (SELECT 'src' || x AS source FROM range(0, 25) t(x)) w ON h.source = w.source")
def collection_status(spark: SparkSession, d: str) -> DataFrame:
    want = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return store.status(table(spark, d, "documents"), want, "source")


_REFS = "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS citation_count FROM lineitem GROUP BY ALL"


@query(f"SELECT src, dst, citation_count, row_number() OVER (PARTITION BY src ORDER BY citation_count DESC, dst)::INTEGER AS rank FROM ({_REFS}) WHERE citation_count >= 2 QUALIFY rank <= 5")
def citation_topn(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("citation_count"))
    return graph.top_references(refs, 5, pos="dst", least=2)


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT -l_suppkey AS s, l_partkey AS t FROM lineitem), e AS (SELECT s AS src, t AS dst FROM p UNION ALL SELECT t, s FROM p),
b AS (SELECT -1::BIGINT AS node, 0 AS level UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.node WHERE b.level < 2)
SELECT node, min(level)::INTEGER AS level FROM b GROUP BY node""")
def citation_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Over the edges of citation_topn, all of them and both ways; suppliers are negative nodes, parts positive ones."""
    pairs = table(spark, d, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.levels(edges, spark.range(1).select((F.col("id") - 1).alias("id")), depth=2)


_CITED = f"r AS (SELECT src, dst, citation_count, (src + dst) % 2 = 0 AS downloaded FROM (SELECT -src AS src, dst, citation_count FROM ({_REFS}) UNION ALL SELECT dst, -src, citation_count FROM ({_REFS}))), t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY citation_count DESC, dst)::INTEGER AS rank FROM r QUALIFY rank <= 10)"


@query(f"""
WITH {_CITED},
f1 AS (SELECT DISTINCT -s_suppkey AS source FROM supplier WHERE s_acctbal < 3000), l1 AS (SELECT source, dst AS node, rank, downloaded FROM t JOIN f1 ON src = source),
f2 AS (SELECT DISTINCT node AS source FROM l1 WHERE downloaded AND node NOT IN (SELECT source FROM f1)), l2 AS (SELECT source, dst AS node, rank, downloaded FROM t JOIN f2 ON src = source),
f3 AS (SELECT DISTINCT node AS source FROM l2 WHERE downloaded AND node NOT IN (SELECT source FROM f1) AND node NOT IN (SELECT source FROM l1) AND node NOT IN (SELECT source FROM l2)), l3 AS (SELECT source, dst AS node, rank, downloaded FROM t JOIN f3 ON src = source)
SELECT *, 1::INTEGER AS level FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3""")
def citation_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of the most cited references from suppliers of a low balance on, in two runs: the first stops after one level, the second goes on. Suppliers are negative
    nodes; what has an even sum with its source was downloaded."""
    counted = table(spark, d, "lineitem").groupBy((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("citation_count"))
    refs = counted.unionByName(counted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "citation_count")).withColumn("downloaded", (F.col("src") + F.col("dst")) % 2 == 0)
    papers = table(spark, d, "supplier").filter("s_acctbal < 3000").select((-F.col("s_suppkey")).alias("paper"))
    path = scratch(spark, "expansion")
    graph.expand(papers, refs, path, 1)
    return graph.expand(papers, refs, path, 3)


@query("""
SELECT user_id % 10 AS part, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed, sum((props::JSON->>'k')::BIGINT)::BIGINT AS chunks
FROM events GROUP BY 1""")
def ingest_status_counts(spark: SparkSession, d: str) -> DataFrame:
    status = lambda s, name: F.count_if(F.col("event_type") == s).alias(name)
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("attempted"), status("purchase", "ok"), status("view", "skipped"), status("error", "failed"), F.sum(k).alias("chunks"))


@query("SELECT event_type, count(*) AS spans, count(DISTINCT user_id) AS traces, round(avg(value), 6) AS mean_value, sum(coalesce((props::JSON->>'k')::BIGINT, 0) + coalesce((props::JSON->>'none')::BIGINT, 0))::BIGINT AS tokens FROM events GROUP BY 1")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.coalesce(F.get_json_object("props", p).cast("long"), F.lit(0))
    rows = table(spark, d, "events").groupBy("event_type")
    return rows.agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("user_id").alias("traces"), F.round(F.avg("value"), 6).alias("mean_value"), F.sum(part("$.k") + part("$.none")).alias("tokens"))


_TOPICS = "SELECT d.doc_id, d.text, CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS topic FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic"))
    return table(spark, d, "documents").select("doc_id", "text", "source").join(e, "doc_id")


@query(f"SELECT topic, string_agg(left(text, 300), chr(10) || '---' || chr(10) ORDER BY k) AS samples FROM (SELECT topic, text, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS k FROM ({_TOPICS}) WHERE topic <> -1 QUALIFY k <= 3) GROUP BY topic")
def cluster_samples(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_samples(_topics(spark, d), "topic", "doc_id", "text")


@query(f"SELECT count(DISTINCT topic) FILTER (topic <> -1) AS n_clusters, count(*) FILTER (topic = -1) AS n_noise FROM ({_TOPICS})")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_stats(_topics(spark, d), "topic")


@query("SELECT d.source, string_agg(DISTINCT 'topic_' || e.label, ' ' ORDER BY 'topic_' || e.label) AS topics FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def topic_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("topic_"), F.col("label").cast("string")).alias("name"))
    return cluster.topic_names(table(spark, d, "documents").select("doc_id", "source").join(e, "doc_id"), ["source"], "name")


@query()
def topic_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Density topics of each label's vectors, and their places in the plane; tested against a plain hierarchy."""
    return cluster.topic_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query()
def topic_tree(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of each label's hierarchy and their stabilities; tested against a plain hierarchy."""
    return cluster.topic_tree(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


_PARTS = "p AS (SELECT p_brand AS g, p_partkey AS id, p_size::DOUBLE AS a, p_retailprice / 20 AS b FROM part)"


@query(f"""
WITH RECURSIVE {_PARTS}, e AS MATERIALIZED (SELECT x.g, x.id, y.id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM p x JOIN p y ON x.g = y.g AND x.id <> y.id),
c AS MATERIALIZED (SELECT g, id, d AS core FROM e QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY d, other) = 3),
r AS MATERIALIZED (SELECT e.g, e.id, e.other FROM e JOIN c x ON x.g = e.g AND x.id = e.id JOIN c y ON y.g = e.g AND y.id = e.other WHERE greatest(d, x.core, y.core) <= 2),
w AS (SELECT g, id, id AS part FROM p UNION SELECT r.g, r.other, w.part FROM w JOIN r ON r.g = w.g AND r.id = w.id)
SELECT w.g, w.id, round(any_value(core), 6) AS core, min(part) AS part FROM w JOIN c ON c.g = w.g AND c.id = w.id GROUP BY w.g, w.id""")
def density_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each brand by size and price: how dense each place is, and what hangs together at a reach of 2, as a cut through the spanning tree."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20).alias("p"))
    return hierarchy.core_and_parts(p, 2.0).select("g", "id", F.round("core", 6).alias("core"), "part")


@query("SELECT region, count(*) AS n FROM (SELECT CASE WHEN r < 0.05 THEN 'equation' WHEN w / h > 3 THEN 'table' ELSE 'figure' END AS region FROM (SELECT p_size / 60.0::DOUBLE AS r, p_size::DOUBLE AS w, p_retailprice / 100 AS h FROM part) WHERE r BETWEEN 0.02 AND 0.85) GROUP BY region")
def figure_regions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_size") / F.lit(60.0)).alias("r"), F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") / 100).alias("h"))
    kept = p.filter(cluster.figure_kept(F.col("r"), F.lit(False)))
    return kept.groupBy(cluster.region_type(F.col("r"), F.col("w"), F.col("h")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, 'q:' || substr(sha256('{\"collections\":[\"arXiv\",\"arxiv-hep\"],\"extra\":\"year>=2000\",\"query\":\"' || lower(role) || '\"}'), 1, 32) AS key FROM conversations")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    c = F.array(F.lit("arxiv-hep"), F.lit("arXiv"))
    return table(spark, d, "conversations").select("conv_id", "turn", cache.cache_key(F.concat(F.lit(" "), F.upper("role"), F.lit("\n")), c, F.lit("year>=2000")).alias("key"))


@query("""
WITH live AS (SELECT user_id, arg_max(value, ts) AS value FROM events WHERE event_type = 'view' AND ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)
SELECT u.user_id, live.value, live.value IS NOT NULL AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN live USING (user_id)""")
def cache_lookup_ttl(spark: SparkSession, d: str) -> DataFrame:
    events, now = table(spark, d, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    entries = cache.store_entries(events.filter((F.col("event_type") == "view") & (F.col("ts").cast("timestamp") <= now)).select("user_id", "value", F.col("ts").cast("timestamp").alias("at")), "at", 86400)
    requests = events.select("user_id").distinct().withColumn("now", now)
    return cache.lookup(requests, entries, key="user_id").select("user_id", "value", "hit")


@query("SELECT doc_id, left(text, 80) AS title, list_slice(['a','b','c','d','e','f','g','h','i','j','k','l'], 1, 10) AS authors, md5(left(text, 500)) AS abstract_md5, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS citation_count FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0")
def reference_normalise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.left("text", F.lit(80)))
    names = F.array(*[F.lit(c) for c in "abcdefghijkl"])
    rows = docs.filter(graph.valid_reference(title, F.col("doc_id") % 11, F.lit(0)))
    made = rows.select("doc_id", *graph.normalise_reference(title, names, F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))))
    return made.select("doc_id", "title", "authors", F.md5("abstract").alias("abstract_md5"), "citation_count")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'arxiv' WHEN doc_id % 4 = 1 OR doc_id % 4 = 2 AND doc_id % 8 = 2 THEN 'unpaywall' ELSE 'none' END AS availability FROM documents")
def availability_case(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda c: F.when(c, F.lit("x"))
    return table(spark, d, "documents").select("doc_id", graph.availability(pick(i % 4 == 0), pick(i % 4 == 1), pick(i % 4 == 2), pick(i % 8 == 2)).alias("availability"))


@query(r"SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text || ' see 2101.0' || lpad((doc_id % 1000)::VARCHAR, 4, '0') || 'v2 and 2101.00001, 1706.3762.', '\b(\d{4}\.\d{4,5}(?:v\d+)?)\b', 1), lambda x: split_part(x, 'v', 1))).list_sort() AS ids FROM documents")
def arxiv_id_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" see 2101.0"), F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0"), F.lit("v2 and 2101.00001, 1706.3762."))
    return table(spark, d, "documents").select("doc_id", F.array_sort(tx.paper_ids(text)).alias("ids"))


@query("SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All events land as two sets of files; the stream takes each set up once and leaves the last value of each user."""
    source, state = scratch(spark, "landing"), scratch(spark, "ingested")
    schema = "user_id long, ts timestamp, value double"
    at = F.col("ts").cast("timestamp")  # an event without a time or a value comes before all others, without a value
    events = table(spark, d, "events").select("user_id", F.when(F.col("value").isNotNull(), at).alias("ts"), F.when(at.isNotNull(), F.col("value")).alias("value"))
    s = store.Store(spark, f"{state}/store", "user_id")
    late = F.coalesce(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(False))
    for part in (~late, late):
        events.filter(part).write.mode("append").parquet(source)
        ingest_files(spark, source, schema, s, "users", f"{state}/checkpoint", order=["ts", "value"])
    return s.read("users").select("user_id", "value")
