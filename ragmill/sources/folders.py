"""Folders that all executors share: where tables and files go that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_new: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session that leaves it out gets a temporary one, deleted at its end."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ragmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    _new.append(f"{shared_dir(spark)}/ragmill/{name}-{uuid.uuid4().hex}")
    return _new[-1]


def sweep(spark: SparkSession) -> int:
    """Deletes what this session has put under new paths and gives their number. DataFrames that read from there are of no use then: call it
    when their rows have been taken or written elsewhere."""
    n = len(_new)
    while _new:
        remove(spark, _new.pop())
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: what is used more than once is computed once, and a lost executor costs
    its own tasks."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    at, fs = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    at, fs = _at(spark, old)
    if not fs.rename(at, _at(spark, new)[0]):
        raise OSError(f"cannot rename {old} to {new}")


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
