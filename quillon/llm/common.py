"""What the training-data operators share: tables, scratch tables in the shared folder, column handling."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import delete_path, new_scratch_path

#: The six characters that the contracts call white space, as a regular-expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark touches the path, so any store that it reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: texts may be long, and a worker holds a batch several times over.
ARROW_ROWS = 1_000


def make_importable(spark: SparkSession) -> None:
    """Python workers find this library even where only the driver's sys.path has it, and get batches of bounded size."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    session.make_importable(spark)


def give_back() -> None:
    """At a task's end: what a reused Python worker holds free goes back to the system, as other tasks share the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


#: Where settled tables lie that are still there.
_settled: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_paths: set[str] = set()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    Operators discard() what their result doesn't read; what it reads stays until whoever wrote the result calls release().
    """
    path = new_scratch_path(df.sparkSession, name)
    _paths.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _settled[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read any more."""
    for df in tables:
        if path := _settled.pop(df, None):
            delete_path(df.sparkSession, path)
            _paths.discard(path)


def release(spark: SparkSession) -> None:
    """Delete all settled tables that are left: for whoever ran queries, once their results were written or collected."""
    for path in list(_paths):
        delete_path(spark, path)
        _paths.discard(path)


#: A key is hot if it has more than this share of all rows; so there are few hot keys, whatever the size of the table.
HOT_SHARE = 1_000


def look_up(rows: DataFrame, entries: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """rows joined with the columns of entries (one row for each key of rows; ``count``: how many rows have the key, which is dropped).

    The entries of hot keys, HOT_SHARE at most, are broadcast, and their rows are dealt by ``spread`` instead of the key: a key
    that a third of all rows share doesn't land in one task.
    """
    names = [c for c in entries.columns if c not in (key, count)]
    total = entries.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    some = entries.filter(hot & (F.col(count) > 1)).select(F.col(key).alias("__hot"), F.struct(*names).alias("__known"))
    rest = entries.filter(~hot | (F.col(count) <= 1)).select(F.col(key).alias("__cold"), F.struct(*names).alias("__found"))
    told = rows.join(F.broadcast(some), F.col(key) == F.col("__hot"), "left")
    dealt = told.withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)))
    dealt = dealt.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread, F.spark_partition_id())))
    joined = dealt.join(rest.withColumn("__zero", F.lit(0).cast("long")), (F.col("__at") == F.col("__cold")) & (F.col("__salt") == F.col("__zero")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__known.{c}"), F.col(f"__found.{c}")).alias(c) for c in names])


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df and the new columns; an input column of the same name (in any case) gives way to the new one."""
    names = {x.lower() for x in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in new.items()])
