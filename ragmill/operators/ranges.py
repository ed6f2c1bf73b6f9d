"""Running totals, running maxima and places over groups of any size.

Rows are sorted by group and order in ranges of about equal size, as many as the session has shuffle partitions; a range that begins
inside a group carries on what the ranges before it hold of the group. The sorted rows are a table of their own, so a source is read once, and
the table that carries ranges on has a row for each range and each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored

#: monotonically_increasing_id() has the range above this bit, the place in it below.
SHIFT = 33


def _sorted(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with __id, which rises within a range, and __range, which rises with group and order; a written table."""
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order) if by or order else df
    return stored(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__id", SHIFT)), "ranges")


def _carried(rows: DataFrame, by: Sequence[str], *values: Column) -> DataFrame:
    """rows with the values, which are of a group's range, beside each of its rows."""
    table = rows.groupBy(*by, "__range").agg(*values)
    return table.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), *[c for c in table.columns if c not in (*by, "__range")])


def _meet(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    met = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    return rows.join(carried, met)


def _keys(by: Sequence[str]) -> list[str]:
    return [f"__by_{i}" for i in range(len(by))]


def before(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, *, ties: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """Adds the sum (how="sum", 0 of nothing) or the maximum ("max", null of nothing) of value over the group's earlier rows, by an order
    column (nulls last) and then ties."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = _sorted(df.withColumn("__v", value), by, [F.col(order).asc_nulls_last(), *ties])
    carried = _carried(rows, by, fold("__v").alias("__n"))
    earlier = Window.partitionBy(*_keys(by)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__before", fold("__n").over(earlier)).drop("__n")
    own = Window.partitionBy(*by, "__range").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    both = _meet(rows.withColumn("__at", fold("__v").over(own)), carried, by)
    out = F.coalesce("__before", F.lit(0)) + F.coalesce("__at", F.lit(0)) if how == "sum" else F.greatest("__before", "__at")
    return both.select(*df.columns, out.alias(name))


def places(df: DataFrame, by: Sequence[str], *order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place in its group, from 0, by any order; ties are broken either way. A range's rows of a group are numbered
    without a gap already, so they are only moved behind those of the ranges before it."""
    rows = _sorted(df, by, order)
    carried = _carried(rows, by, F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*_keys(by)).orderBy("__r")
    carried = carried.select(*_keys(by), "__r", (F.sum("__n").over(earlier) - F.col("__n") - F.col("__first")).alias("__move"))
    return _meet(rows, carried, by).select(*df.columns, (F.col("__id") + F.col("__move")).alias(name))
