"""Corpus pipeline: language ID, exact dedup, near dedup, secret redaction, packing; each stage is written as Parquet and read again.

All stages but the last return the columns of documents. Nulls, empty and repeated rows, empty tables and further columns
(which end with the first stage) are handled as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, settle, table
from quillon.llm.exact_dedup import exact_dedup, normalised
from quillon.llm.langid import CrossParser, identify, training_rows
from quillon.llm.ngram_join import ngram_jaccard_join
from quillon.llm.packing import default_tokenizer, pack_documents
from quillon.llm.secrets import redacted, secret_findings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle and least similarity in hundredths; token orders that must agree.
SHINGLE_WORDS, SIMILARITY, ORDERS = 5, 80, 2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language stay, with the predicted language in lang; ``und`` (no letter, null) goes.
    Where no language is labelled there is nothing to reject by, and all documents with a letter stay as they are. Repeated rows and null ids stay.
    An empty table gives an empty result."""
    parser = CrossParser.fit(training_rows(docs))
    if not parser.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = identify(docs.select(*COLUMNS), parser).filter(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Of rows (with a key column) those whose key is among the kept ones, one row for each key. Null ids are like any other."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("lang", "source", "n_chars"))
    return rows.join(kept, "key", "left_semi").withColumn("k", first).filter(F.col("k") == 1).select(*COLUMNS)


def _key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), sha)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty; runs of white space are one space) the row with the smallest doc_id stays; of rows that repeat doc_id and
    text, one. Null ids come last. An empty table gives an empty result."""
    kept = exact_dedup(docs).filter("kept").select(_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return _only(docs.select(*COLUMNS).withColumn("key", _key(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256))), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the smallest doc_id, and of its texts the one with the smallest hash. Rows are told apart by
    id and text, so an id that repeats with another text saves no copy. Texts without words stay, null ids come last. An empty table
    gives an empty result."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    near = ngram_jaccard_join(docs, n=SHINGLE_WORDS, num=SIMILARITY, den=100, orders=ORDERS, tag=sha)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    best = near.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(row).alias("r")).select("r.doc_id", "r.tag")
    kept = best.unionByName(near.filter(F.col("component").isNull()).select("doc_id", "tag")).select(_key(F.col("doc_id"), F.col("tag")).alias("key"))
    return _only(docs.select(*COLUMNS).withColumn("key", _key(F.col("doc_id"), sha)), kept)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones and null texts too; found secrets are replaced by a mark, private keys to their last line, and n_chars follows
    the text. An empty table gives an empty result."""
    found = secret_findings(docs.select(*COLUMNS))
    text = redacted(F.col("text"), F.col("findings"))
    changed = F.size("findings") > 0
    return found.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences: every row is packed, repeated ones each on its own, null texts as one id. An empty table gives an
    empty result."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("language_id", keep_languages), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack)]
#: The stages use models and contents that SQL can't express; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one is written; the last one goes with release()."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(done)
    return docs
