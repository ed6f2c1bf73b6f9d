"""Latency, length and throughput reports with the percentile rules that each report states."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import ranges


def ranked(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, v, n (how many of the value), first (the rank of its first, from 0) and total, nulls left out.

    Ranks come from counts by value, a range of values at a time: neither all rows nor all values are sorted in one task, and no
    buffer holds the values of a group. The counts are a table of their own, so df is read once.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = ranges.before(counts, by, "v", F.col("n"), "first")
    if not by:
        return placed.join(F.broadcast(whole))  # one row
    return placed.join(whole.toDF(*[f"__k{i}" for i in range(len(by))], "total"), _same(by)).drop(*[f"__k{i}" for i in range(len(by))])


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return out


def _at(rank: Column) -> Column:
    return F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("n")), F.col("v")))


def _named(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def percentiles(df: DataFrame, value: str, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and p50, p90, ... by linear interpolation between ranks, exact; groups without a value are left out."""
    out = []
    for p in percents:
        place = F.lit(p / 100) * (F.col("total") - 1)
        out += [_at(F.floor(place)).cast("double").alias(f"__a{_named(p)}"), _at(F.ceil(place)).cast("double").alias(f"__b{_named(p)}"), F.max(place - F.floor(place)).alias(f"__f{_named(p)}")]
    found = ranked(df, value, by).groupBy(*by).agg(*out)
    a, b, f = (lambda p, k=k: F.col(f"__{k}{_named(p)}") for k in "abf")
    return found.select(*by, *[(a(p) + (b(p) - a(p)) * f(p)).alias(_named(p)) for p in percents])


def _beside(groups: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """A report with its groups' percentiles, 0.0 where a group has no value."""
    names = [c for c in cuts.columns if c not in by]
    renamed = cuts.toDF(*[f"__k{i}" for i in range(len(by))], *names)
    met = groups.join(renamed, _same(by), "left") if by else groups.join(F.broadcast(renamed), how="left", on=F.lit(True))
    return met.select(*groups.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def nearest_rank(df: DataFrame, value: str, percents: Sequence[float]) -> DataFrame:
    """The value at round(p * (n - 1)), half to even, for each percentile."""
    return ranked(df, value).agg(*[_at(F.bround(F.lit(p / 100) * (F.col("total") - 1))).alias(_named(p)) for p in percents])


def length_statistics(df: DataFrame, value: str) -> DataFrame:
    """n, mean, upper median (element n // 2 of the sorted values), min, max and the population's deviation."""
    r = ranked(df, value)
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("v").cast("double") * F.col("v") * F.col("n")) / F.sum("n")
    return r.agg(F.sum("n").alias("n"), mean.alias("mean"), _at(F.floor(F.col("total") / 2)).alias("upper_median"), F.min("v").alias("min"), F.max("v").alias("max"), F.sqrt(square - mean * mean).alias("std_pop"))


def length_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = df.groupBy(*by).agg(F.count(value).alias("n"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
    return _beside(groups, percentiles(df, value, (50, 90), by), by)


def describe(df: DataFrame, columns: Sequence[str], percents: Sequence[float] = (25, 50, 75, 90, 99, 99.9, 99.99)) -> DataFrame:
    """A row for each column: count, mean, sample deviation, min, interpolated percentiles, max."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    groups = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return groups.join(percentiles(long, "value", percents, ["column"]), "column", "left")


def span(start: Column, end: Column) -> Column:
    """end - start, 0 if negative or if either is missing or zero."""
    known = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    return F.when(known, F.greatest(F.lit(0.0), end - start)).otherwise(F.lit(0.0))


def request_timing(queued: Column, scheduled: Column, first: Column, last: Column, tokens: Column) -> Column:
    """queued, prefill and decode time, time to first token, and decode time per further token."""
    decode = span(first, last)
    return F.struct(span(queued, scheduled).alias("queue"), span(scheduled, first).alias("prefill"), span(queued, first).alias("ttft"), decode.alias("decode"), F.when(tokens > 1, decode / (tokens - 1)).otherwise(F.lit(0.0)).alias("tpot"))


def prediction_row(example: Column, k: Column, output_tokens: Column, reward: Column, seconds: Column) -> Column:
    """A request's row in a prediction log: its example, branches, tokens, reward and time, and time per token (0.0 of none)."""
    per_token = F.when(output_tokens > 0, seconds / output_tokens).otherwise(F.lit(0.0))
    return F.struct(example.alias("example_id"), k.alias("k"), output_tokens.alias("output_tokens"), reward.cast("double").alias("reward"), seconds.cast("double").alias("seconds"), per_token.alias("seconds_per_token"))


def latency_report(df: DataFrame, wall_seconds: float | Column, columns: Sequence[str]) -> DataFrame:
    """Requests a second and interpolated p50 and p90 of each column, 0.0 of nothing."""
    wall = F.lit(wall_seconds) if isinstance(wall_seconds, int | float) else wall_seconds
    out = df.agg(F.count(F.lit(1)).alias("n_requests"), (F.count(F.lit(1)) / wall).alias("requests_per_s"))
    for c in columns:
        cuts = percentiles(df, c, (50, 90))
        out = _beside(out, cuts.toDF(*[f"{c}_{p}" for p in cuts.columns]), ())
    return out


def group_times(df: DataFrame, group: str) -> DataFrame:
    """A group is queued and scheduled when its first child is."""
    return df.groupBy(group).agg(F.min("queued_ts").alias("queued_ts"), F.min("scheduled_ts").alias("scheduled_ts"))


def histogram_digest(samples: DataFrame) -> DataFrame:
    """Samples (name, labels, value) of histogram buckets by name and labels but `le`: a map from bound to count."""
    rest = F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != "le")))
    pairs = F.collect_list(F.struct(F.col("labels")["le"].alias("k"), F.col("value").alias("v")))
    return samples.where("map_contains_key(labels, 'le')").groupBy("name", rest.alias("labels")).agg(F.map_from_entries(F.array_sort(pairs)).alias("buckets"))


#: Events of a store that a task takes one after the other.
STEPS = 1 << 16


def live_counts(events: DataFrame, group: str, order: str, delta: str, capacity: int) -> DataFrame:
    """live, free and refused for each event of a bounded store: +1 takes a row and is refused if none is free, -1 gives one back and is
    refused if none is live. Order has no ties in a group.

    A run of events maps the live rows before it to those after it as a sum between two bounds, and so do two runs after each other: runs
    of STEPS events are first folded to such a map each, then taken through from where the maps before them lead.
    """
    n = ranges.places(events, [group], F.col(order), name="__i").withColumn("__run", F.floor(F.col("__i") / STEPS))
    kind = events.schema[group].dataType.simpleString()

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high, total = 0, capacity, 0
        for d in rows.sort_values("__i")[delta].tolist():
            low, high, total = min(max(low + d, 0), capacity), min(max(high + d, 0), capacity), total + d
        return pd.DataFrame({"__g": [key[0]], "__r": [key[1]], "low": [low], "high": [high], "total": [total]})

    maps = n.groupBy(group, "__run").applyInPandas(fold, f"__g {kind}, __r long, low long, high long, total long")
    earlier = F.array_sort(F.collect_list(F.struct("__r", "low", "high", "total")).over(Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)))  # one for each run
    start = F.aggregate(earlier, F.lit(0).cast("long"), lambda x, m: F.least(F.greatest(x + m["total"], m["low"]), m["high"]))
    starts = maps.select("__g", "__r", start.alias("__start"))
    met = n[group].eqNullSafe(starts["__g"]) & (n["__run"] == starts["__r"])
    columns, fields = events.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__i")
        live, out, refused = int(rows["__start"].iloc[0]), [], []
        for d in rows[delta].tolist():
            after = min(max(live + d, 0), capacity)
            refused.append(after != live + d)
            live = after
            out.append(live)
        return rows[columns].assign(live=out, free=[capacity - x for x in out], refused=refused)

    return n.join(starts, met).groupBy(group, "__run").applyInPandas(take, f"{fields}, live long, free long, refused boolean")


def workload_estimate(throughput: Column, latency_ms: Column) -> Column:
    """Requests in flight by Little's law."""
    return F.avg(throughput * latency_ms / 1000.0)


def best_concurrency(df: DataFrame, by: Sequence[str], ttft: float, tpot: float) -> DataFrame:
    """The greatest concurrency that meets both latency limits, null if none does."""
    ok = (F.col("ttft") <= ttft) & (F.col("tpot") <= tpot)
    return df.groupBy(*by).agg(F.max(F.when(ok, F.col("concurrency"))).alias("best_concurrency"))
