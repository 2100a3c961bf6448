"""Registration of queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks, search
from .. import session
from ..session import make_importable, new_scratch_path as scratch  # noqa: F401  queries take it from here

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: White-space tokens of a text, and a text without white space at its ends, in the oracle's dialect.
SQL_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda w: w <> '')"
SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


_INDEXES: dict[tuple, DataFrame] = {}
_BLOCKS: dict[tuple, blocks.BlockIndex] = {}


def _documents_key(spark: SparkSession, d: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return spark.sparkContext.applicationId, d, tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index over documents, built in the shared folder at its first use in a session, and anew when the table's files change."""
    key = _documents_key(spark, d)
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(table(spark, d, "documents"), scratch(spark, "index"))
    return _INDEXES[key]


def stored_blocks(spark: SparkSession, d: str) -> blocks.BlockIndex:
    """The block index over the same postings, likewise; from the texts where ids are told apart, else from the index, as texts of one id count as one."""
    key = _documents_key(spark, d)
    if key not in _BLOCKS:
        docs = table(spark, d, "documents")
        of_texts = search.told_apart(docs)
        _BLOCKS[key] = blocks.blocks_of_texts(docs, scratch(spark, "blocks")) if of_texts else blocks.build_blocks(stored_index(spark, d), scratch(spark, "blocks"))
    return _BLOCKS[key]


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of the session, the indexes too; for whoever ran queries, once their results were written or collected."""
    _INDEXES.clear()
    _BLOCKS.clear()
    session.release(spark)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A bounded result that several branches of a plan read: written to the shared folder once, so that it isn't computed by each."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
