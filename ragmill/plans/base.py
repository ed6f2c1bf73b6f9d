"""Registry of queries: a name, a plan and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("from lines", f"from {LINES}")
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Lines of an order under a number of their own, as lineitem may repeat an order's line number: rows stay whole.
LINES = """(select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag)::int l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag
 from lineitem) lines"""

#: Lines of a task.
TASK_ROWS = 100_000


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window is an order's, whose lines are few. Tasks sort their rows several times before they are shuffled again, so there are as
    many as the table's rows (counted in its files' footers) need: what a task holds doesn't grow with the table."""
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*columns)).cast("int")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *columns)
    tasks = max(spark.sparkContext.defaultParallelism, ceil(rows.count() / TASK_ROWS))
    return rows.repartition(tasks, "l_orderkey").withColumn("l_linenumber", place)
