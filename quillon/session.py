"""What queries need of a session: an importable library, and scratch paths in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def make_importable(spark: SparkSession) -> None:
    """Python workers find this library even where only the driver's sys.path has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def active_importable() -> None:
    """make_importable for functions that see columns only; without a session there is nothing to do yet."""
    if spark := SparkSession.getActiveSession():
        make_importable(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a temporary folder stands in if
    all run on one machine (tests); on a cluster it is an error, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Scratch paths that were given out and not deleted yet.
_given: set[str] = set()


def new_scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _given.add(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _given.discard(path)


def release(spark: SparkSession) -> None:
    """Delete all scratch paths that are left: results that were neither written nor collected can't be read any more."""
    for path in list(_given):
        delete_path(spark, path)
