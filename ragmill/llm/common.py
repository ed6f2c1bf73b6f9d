"""What the training-data operators share: tables in the cluster's shared folder, row keys and small expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_path
from ..sources.folders import remove as remove_path

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"

_scratch: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The copy outlives any executor, so a lost one costs its own tasks only. Within scratch_tables() it goes when that ends.
    """
    return stored(df, name)[0]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when each has ended; as a rule they stay until the driver's memory runs short."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """shared_table and the path of the copy."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Deletes at its end the tables that shared_table has written meanwhile, but for those written by the function it gives.

    For work whose result is written before the end; what is still to be read from the tables must not outlive it.
    """
    _scratch.append([])

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        out = stored(df, name)
        _scratch[-1].remove(out[1])
        if len(_scratch) > 1:
            _scratch[-2].append(out[1])
        return out

    try:
        yield keep
    finally:
        for path in _scratch.pop():
            remove_path(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of df has it (case aside, as Spark compares names)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def without_rows(df: DataFrame, gone: DataFrame, *, key: str, text: str) -> DataFrame:
    """df without the rows whose id (null-safe) and text hash are in gone, a written table of two columns: id and hash. Any other
    columns of df may have any names."""
    k, h = fresh(df, "gone_key", "gone_hash")
    gone = gone.toDF(k, h)
    return df.join(gone, df[key].eqNullSafe(gone[k]) & (text_hash(df[text]) == gone[h]), "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once for each row and use it any number of times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hash(text: Column) -> Column:
    """Tells rows apart that share an id; rows alike in both are repeated rows and get like results."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
