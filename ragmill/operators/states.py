"""Aggregates whose states are rows: runs add theirs, states merge in any order, and values can be taken, and taken out, at any time.

A state row is a group, a metric and what all its kinds need: a count, a mean and a sum of squared deviations, the ends, and a sketch of
distinct values. A run's states are a folder of its own, so a run that is repeated replaces what it had added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import exists, names, remove, stored

KINDS = ("count", "mean", "sum", "variance", "min", "max", "distinct")


def states(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """by, metric, n, mean, m2, low, high, sketch: a row for each group and metric. Nulls are not counted."""
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), c.cast("double").alias("x")) for name, c in metrics.items()])).alias("m"))
    x = F.col("m.x")
    own = rows.groupBy(*by, F.col("m.metric").alias("metric")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg(F.xxhash64(x)).alias("sketch")
    )
    return own


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of the same group and metric in one. Two states merge by the difference of their means, so large values lose no digits; a
    group has as many to merge as there are runs."""
    one = F.struct("n", "mean", "m2")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def fold(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2")))

    whole = F.aggregate(F.array_sort(F.collect_list(one)), zero, fold).alias("s")
    out = parts.groupBy(*by, "metric").agg(whole, F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("sketch").alias("sketch"))
    return out.select(*by, "metric", "s.n", F.when(F.col("s.n") > 0, F.col("s.mean")).alias("mean"), F.when(F.col("s.n") > 0, F.col("s.m2")).alias("m2"), "low", "high", "sketch")


def values(whole: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, metric and the KINDS; variance is that of a sample."""
    return whole.select(
        *by, "metric", F.col("n").alias("count"), "mean", (F.col("mean") * F.col("n")).alias("sum"), F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).alias("variance"),
        F.col("low").alias("min"), F.col("high").alias("max"), F.hll_sketch_estimate("sketch").alias("distinct"),
    )


class Ledger:
    """States of runs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], metrics: Mapping[str, Column]) -> None:
        self.spark, self.path, self.by, self.metrics = spark, path, list(by), dict(metrics)

    def add(self, run: str, df: DataFrame) -> None:
        """A run's states; those that a run of this name had added are replaced."""
        states(df, self.by, self.metrics).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def runs(self) -> list[str]:
        return sorted(name.removeprefix("run=") for name in names(self.spark, self.path) if exists(self.spark, f"{self.path}/{name}/_SUCCESS"))

    def values(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Of these runs, or of all."""
        chosen = self.runs() if runs is None else list(runs)
        if not chosen:
            raise ValueError("no run has added anything")
        return values(merged(self.spark.read.parquet(*[f"{self.path}/run={r}" for r in chosen]), self.by), self.by)

    def dump(self) -> DataFrame:
        """The values of all runs so far, which are then taken out: what is added later starts anew. Runs added meanwhile stay."""
        chosen = self.runs()
        out = stored(self.values(chosen), "dumped")
        for run in chosen:
            remove(self.spark, f"{self.path}/run={run}")
        return out
