"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by its content. The ledger remembers which (blob, rule, version of the
rule) were scanned; only pairs that it lacks are scanned, once per distinct blob, and findings join back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_scratch_path, table


@dataclass(frozen=True)
class Rule:
    """kind: name in spans. regex: Java syntax. quick: a cheaper regex that every text with a match also matches.
    group: what must have ``least`` characters. version: raised when the rule changes, so that blobs are scanned anew."""

    kind: str
    regex: str
    quick: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Fixed values of the op3 contract, in its order. Runs of one class match whole, so {n,} finds just the runs of n or more.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw(?:or)?d|secret|token|api_?key)[\"'\x20]*[:=]", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
)
#: The method's own: signed web tokens, and private keys to their last line; without one, what follows the first line and may be a key.
EXTRA_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\."),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?s:.*?)-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\x20\x09-\x0D]*)", r"PRIVATE KEY-----", version=3),
)
ALL_RULES = BASE_RULES + EXTRA_RULES
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the rule's leftmost non-overlapping matches, in code points, end exclusive.

    split() gives what lies between the matches and regexp_extract_all() the matches; their lengths give the places.
    """
    between = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    must = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    lengths = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("long"), F.transform(must, F.length).alias("must"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), empty.alias("got")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["long"], F.lit(0))).alias("at"),
            F.when(
                F.coalesce(x["must"] >= rule.least, F.lit(False)),
                F.concat(acc["got"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["long"]).alias("end")))),
            ).otherwise(acc["got"]).alias("got"),
        ),
        lambda acc: acc["got"],
    )
    return F.when(text.rlike(rule.quick), walked).otherwise(empty)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger_path: str, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """Scan the (blob, rule, version) that the ledger at ``ledger_path`` lacks, append them to it, and return it.

    versions: any rows with a text column; null text is the empty blob. A pair without findings is remembered with
    an empty list. Blobs are told apart by content address and content, so equal rows cost one scan. A ledger that
    doesn't exist yet is empty; an interrupted run has appended nothing, or all (the append is one committed write).
    """
    spark = versions.sparkSession
    rows = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    every = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if (known := _read_ledger(spark, ledger_path)) is not None:
        seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
        rows = rows.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
        blobs = rows.groupBy("blob", "text", "todo").agg(F.count(F.lit(1)).alias("copies"))
    else:
        blobs = rows.groupBy("blob", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("todo", every)
    found = F.array(
        *[
            F.when(
                F.array_contains("todo", f"{r.kind}@{r.version}"),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")),
            )
            for r in rules
        ]
    )
    new = blobs.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("blob", "f.*")
    new.write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def _read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def secret_findings(versions: DataFrame, ledger_path: str | None = None, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES, salts: int = 16) -> DataFrame:
    """versions and ``findings``: array<struct<start,kind_no,end,kind>> in order of start, then rule.

    Rows are neither dropped nor merged: repeated rows and all paths of a blob get its findings. Without findings, and for null texts, the
    list is empty. Texts of any length are scanned whole. Other columns stay; an input column named findings gives way. An empty table
    gives an empty result. ``ledger_path`` None: a new ledger in the shared folder. Findings meet rows under ``salts`` keys a blob, so a hot
    blob's rows don't meet in one task.
    """
    spark = versions.sparkSession
    path = ledger_path or new_scratch_path(spark, "ledger")
    ledger = scan_unseen(versions, path, text_col, rules)
    now = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules])
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    hits = (
        ledger.filter(now & (F.size("spans") > 0))
        .dropDuplicates(["blob", "kind", "version"])  # two runs at once may both have appended a pair
        .withColumn("kind_no", number)
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind_no").alias("kind_no"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("found"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("findings"))
    )
    base = versions.select(*[F.col(f"`{c}`") for c in versions.columns if c.lower() != "findings"])
    hits = hits.select(F.col("blob").alias("__blob"), "findings", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    joined = base.withColumn("__blob", blob_of(F.col(text_col))).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts))).join(hits, ["__blob", "__salt"], "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(F.col("findings"), none).alias("findings"))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, findings: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every found span, or union of overlapping spans, replaced by ``mark``."""
    end = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = F.aggregate(
        findings,
        end,
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(findings) > 0, kept).otherwise(text)


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds' counts alone, which SQL can express."""
    return op3(spark, sf_dir).select("doc_id", *[f"n_{r.kind}" for r in BASE_RULES])


COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
       len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
       len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM t
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of every document, over a new ledger. Odd rows as in secret_findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_findings(docs)
    base = F.filter("findings", lambda x: x["kind_no"] <= len(BASE_RULES))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))
