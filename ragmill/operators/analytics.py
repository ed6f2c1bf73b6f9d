"""Reports over result tables: conditional means, contingency tables, rank buckets, distributions, frontiers, intervals."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def column_means(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def mean_where(value: Column, condition: Column) -> Column:
    """Mean over the rows where the condition holds; null if none."""
    return F.avg(F.when(condition, value))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def threshold_report(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """side (below, rest, all), n, percent of all, mean_score and worst (least) score; a null score is in neither side."""
    side = F.when(F.col(score) < threshold, "below").when(F.col(score) >= threshold, "rest")
    cells = df.select(side.alias("side"), F.col(score).alias("s")).cube("side").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.min("s").alias("worst"), F.grouping_id().alias("g"))
    # At most four rows by now.
    whole = F.max(F.when(F.col("g") == 1, F.col("n"))).over(Window.partitionBy())
    named = cells.select(F.when(F.col("g") == 1, "all").otherwise(F.col("side")).alias("side"), "n", (F.lit(100.0) * F.col("n") / whole).alias("percent"), "mean_score", "worst")
    return named.where("side is not null")


def group_means(df: DataFrame, by: str, metrics: Mapping[str, str]) -> DataFrame:
    """n and the mean of each metric (name -> column) by group; columns that df lacks are left out."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(name) for name, c in metrics.items() if c in df.columns])


def run_means(df: DataFrame, scalars: Sequence[str], by_key: str) -> DataFrame:
    """measure, k and value: means over runs of scalar columns (k null) and of a map's values for each of its keys."""
    out = df.agg(*[F.avg(c).alias(c) for c in scalars]).unpivot([], list(scalars), "measure", "value").select("measure", F.lit(None).cast("int").alias("k"), "value")
    keyed = df.select(F.explode(by_key).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("value"))
    return out.unionByName(keyed.select(F.lit(by_key).alias("measure"), F.col("k").cast("int").alias("k"), "value"))


def means_by_label(df: DataFrame, labels: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """Means of columns, and n, by a label that another system gives the same questions."""
    return df.join(labels.select(key, label), key).groupBy(label).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("n"))


def needle_report(df: DataFrame) -> DataFrame:
    """Samples, those with and without a needle, and the mean number of passages; 0.0 of nothing."""
    has = F.coalesce(F.col("has_needle"), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("num_samples"), F.count_if(has).alias("num_positive"), F.count_if(~has).alias("num_negative"), F.coalesce(F.avg(F.size("passages")), F.lit(0.0)).alias("avg_passages"))


def preference_accuracy(df: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    """accuracy: how often the chosen answer's reward is the greater one, and n."""
    return df.agg(F.avg((chosen > rejected).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def integer_report(df: DataFrame, predicted: Column, label: Column, tokens: Column, seconds: float, invalid: int = -9999999) -> DataFrame:
    """Accuracy and invalid rate of whole-number answers, questions and tokens a second (0.0 of no time)."""
    rate = lambda x: x / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)
    n = F.count(F.lit(1))
    return df.agg(F.avg((predicted == label).cast("int")).alias("accuracy"), F.avg((predicted == invalid).cast("int")).alias("invalid_rate"), n.alias("num_questions"), rate(n).alias("questions_per_second"), rate(F.sum(tokens)).alias("tokens_per_second"))


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """a, b, n and percent of all for the four cells, both margins and the whole (nulls mark the margins)."""
    cells = df.select(a.alias("a"), b.alias("b")).cube("a", "b").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    # At most nine rows by now: the window over all of them is small at every input size.
    whole = F.max(F.when(F.col("__g") == 3, F.col("n"))).over(Window.partitionBy())
    return cells.select("a", "b", F.col("__g").alias("margin"), "n", (F.lit(100.0) * F.col("n") / whole).alias("percent"))


def cross_counts(a: Column, b: Column) -> list[Column]:
    """Both, only a, only b, neither."""
    return [F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither")]


def classification(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; a measure without cases is 0.0."""
    p, a = predicted.cast("boolean"), actual.cast("boolean")
    counts = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y).cast("double"), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select("tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def accuracy_by(df: DataFrame, score: str, *groups: str, digits: int = 2) -> DataFrame:
    """Mean score as a percentage, over all rows and for each value of each group, from one pass."""
    sets = [[], *[[F.col(g)] for g in groups]]
    out = df.groupingSets(sets, *[F.col(g) for g in groups]).agg(F.round(100 * F.avg(score), digits).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    return out.select(*groups, F.col("__g").alias("grouping"), "accuracy", "n")


#: Rank buckets of the pipeline reports.
BUCKETS = ((0, 1), (2, 3), (4, 5), (6, 10), (11, 25), (26, 49), (50, 100))


def rank_buckets(df: DataFrame, rank: str, score: str, buckets: Sequence[tuple[int, int]] = BUCKETS) -> DataFrame:
    """bucket, n, percent of all rows and mean score; empty buckets are there with 0 and null."""
    spark = df.sparkSession
    table = spark.createDataFrame([(f"{a}-{b}", i) for i, (a, b) in enumerate(buckets)], "bucket string, position int")
    case = F.lit(None).cast("string")
    for a, b in buckets:
        case = F.when(F.col(rank).between(a, b), F.lit(f"{a}-{b}")).otherwise(case)
    counted = df.select(case.alias("bucket"), F.col(score).alias("__s")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("__s").alias("mean_score"))
    # As many rows as buckets, and one for ranks in none.
    everything = counted.withColumn("__all", F.sum("n").over(Window.partitionBy()))
    met = F.broadcast(table).join(everything, "bucket", "left")
    whole = F.max("__all").over(Window.partitionBy())
    return met.select("bucket", "position", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(100.0) * F.coalesce("n", F.lit(0)) / whole).alias("percent"), "mean_score")


def task_scores(df: DataFrame, by: Sequence[str], prefix: str = "") -> DataFrame:
    """Mean score over all tasks of a group, the least over those whose name starts with a prefix (null if none), and how many tasks."""
    least = F.min(F.when(F.startswith("task", F.lit(prefix)), F.col("score")))
    return df.groupBy(*by).agg(F.avg("score").alias("mean_score"), least.alias("least_of_prefix"), F.count(F.lit(1)).alias("n_tasks"))


def placed(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Rows of a report numbered from 1 in the order of those columns that it has. A report is small: one row for each run."""
    keys = [c for c in order if c in df.columns]
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def wide(df: DataFrame, row: str, column: str, value: Column, values: Sequence | None = None) -> DataFrame:
    pivoted = df.groupBy(row).pivot(column, list(values)) if values else df.groupBy(row).pivot(column)
    return pivoted.agg(value)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "measure", "value")


def duration_table(df: DataFrame, row: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Sums by row and column, rounded to two digits, with a total row."""
    totals = df.groupBy(row).pivot(column, list(values)).agg(F.sum(value))
    last = df.groupBy(F.lit("total").alias(row)).pivot(column, list(values)).agg(F.sum(value))
    return totals.unionByName(last).select(row, *[F.bround(v, 2).alias(v) for v in values])


def geometric_speedup(baseline: Column, measured: Column) -> Column:
    return F.exp(F.avg(F.ln(baseline / measured)))


def length_distribution(df: DataFrame, length: Column, interval: int) -> DataFrame:
    """bin, n, and running count and percent. Bins are counted first; the running window sees bins, not rows."""
    bins = df.groupBy((F.floor(length / interval) * interval).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.select("bin", "n", F.sum("n").over(run).alias("n_up_to"), (F.lit(100.0) * F.sum("n").over(run) / F.sum("n").over(Window.partitionBy())).alias("percent_up_to"))


def weighted_average(df: DataFrame, value: str, position: str, n: int, *, rising: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Weights 1..n by position (or n..1), over the positions present, rounded to two digits half to even."""
    w = F.col(position) + 1 if rising else F.lit(n) - F.col(position)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.bround(F.sum(F.col(value) * w) / F.sum(w), 2).alias("weighted_avg"))


def ordinal(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """place (1st, 2nd, 3rd, 4th, ... 21th) by falling value, ties by order, nulls without a place."""
    n = F.row_number().over(Window.partitionBy(*by, F.col(value).isNull()).orderBy(F.col(value).desc(), order)).cast("string")
    suffix = F.when(n == "1", "st").when(n == "2", "nd").when(n == "3", "rd").otherwise("th")
    return df.withColumn("place", F.when(F.col(value).isNotNull(), F.concat(n, suffix)))


def best_per(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The row of the greatest value in each group, ties by the least tie column. One partial aggregation, no sort."""
    kept = [c for c in df.columns if c not in by]
    key = F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*kept), key).alias("__b")).select(*by, *[F.col(f"__b.{c}").alias(c) for c in kept])


def top_n(df: DataFrame, n: int, *order: Column, category: str | None = None) -> DataFrame:
    """The first n rows in an order, tagged with a category. The limit is the feature: n rows of each task reach the last one."""
    out = df.orderBy(*order).limit(n)
    return out.withColumn("category", F.lit(category)) if category else out


def pareto_frontier(df: DataFrame, x: str, y: str, epsilon: float = 1e-9) -> DataFrame:
    """Points that no point of greater x beats in y. Only the best y of each x can be on it, so those are taken first; what greater x
    have is carried from range to range."""
    best = df.groupBy(x).agg(F.max(y).alias("__y")).withColumn("__x", -F.col(x))
    edge = ranges.before(best, [], "__x", F.col("__y"), "__m", how="max").where(F.col("__m").isNull() | (F.col("__y") >= F.col("__m") - epsilon))
    return edge.select(x, F.col("__y").alias(y))


def non_overlapped(df: DataFrame, start: str, end: str, by: Sequence[str], *, order: Sequence[str] = ()) -> DataFrame:
    """elapsed: the part of each interval that no interval before it (by start, a number) in its group covers."""
    reached = ranges.before(df, by, start, F.col(end), "__reach", ties=order, how="max")
    return reached.withColumn("elapsed", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("__reach", F.col(start))))).drop("__reach")


def interval_summary(df: DataFrame, name: str, start: str, end: str, by: Sequence[str], *, per_second: float = 1.0) -> DataFrame:
    """For each name: elapsed and total time in seconds, and how many intervals."""
    each = non_overlapped(df, start, end, by, order=[name])
    return each.groupBy(name).agg((F.sum("elapsed") / per_second).alias("elapsed"), (F.sum(F.col(end) - F.col(start)) / per_second).alias("duration"), F.count(F.lit(1)).alias("n"))


def first_rule(text: Column, rules: Mapping[str, str], default: str | None = None) -> Column:
    """Label of the first rule whose pattern is found."""
    out = F.lit(default)
    for pattern, label in reversed(list(rules.items())):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(label)).otherwise(out)
    return out


def profile_json(df: DataFrame, text: str) -> DataFrame:
    """Keys of JSON objects: in how many rows, and in how many missing."""
    keys = df.select(F.explode(F.json_object_keys(text)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return keys.join(F.broadcast(whole)).select("key", "n", (F.col("__all") - F.col("n")).alias("n_missing"))


def profile_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, least, mean and most of the sizes of list columns, and in how many rows a list is missing; 0 of nothing."""
    long = df.select(*[F.coalesce(F.size(c), F.lit(-1)).alias(c) for c in columns]).unpivot([], list(columns), "column", "size")
    size = F.when(F.col("size") >= 0, F.col("size"))
    zero = lambda c, x: F.coalesce(c, F.lit(x))
    return long.groupBy("column").agg(zero(F.min(size), 0).alias("least"), zero(F.avg(size), 0.0).alias("mean"), zero(F.max(size), 0).alias("most"), F.count_if(F.col("size") < 0).alias("n_missing"))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(n)


def vector_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """Absolute and relative differences of paired numbers, and their L2 norms."""
    d = F.abs(F.col(a) - F.col(b))
    r = F.try_divide(d, F.abs(F.col(a)))
    norm = F.sqrt(F.sum(d * d))
    parts = [f(x).alias(f"{n}_{k}") for x, n in ((d, "abs"), (r, "rel")) for f, k in ((F.max, "max"), (F.avg, "mean"), (F.min, "min"))]
    return df.agg(*parts, norm.alias("l2"), F.try_divide(norm, F.sqrt(F.sum(F.col(a) * F.col(a)))).alias("rel_l2"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Two result tables on one configuration: both measures and b / a, null where a is zero."""
    left, right = a.select(*keys, F.col(measure).alias("a")), b.select(*keys, F.col(measure).alias("b"))
    return left.join(right, list(keys)).select(*keys, "a", "b", F.try_divide("b", "a").alias("ratio"))


def heatmap(df: DataFrame, states: str, weights: str, segment: str, segments: Sequence) -> DataFrame:
    """A row for each state, a column for each segment: the greatest weight that the state has there, 0.0 without any."""
    pairs = df.select(segment, F.explode(F.arrays_zip(F.col(states).alias("state"), F.col(weights).alias("weight"))).alias("p")).select(segment, "p.*")
    return pairs.groupBy("state").pivot(segment, list(segments)).agg(F.max("weight")).na.fill(0.0)


def grouped_by_label(df: DataFrame, label: str, pattern: str, names: Sequence[str], value: str) -> DataFrame:
    """Measurements grouped by what a pattern's groups find in their label: a row for each, with its place in the group's rising values
    (from 0) and how many the group has. Groups may have any number."""
    parts = [F.regexp_extract(label, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    rows = df.where(F.regexp_like(F.col(label), F.lit(pattern))).select(*parts, value)
    placed = ranges.places(rows, list(names), F.col(value))
    return placed.join(placed.groupBy(*names).agg(F.count(F.lit(1)).alias("of")), list(names))


def running_counters(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """mean and most: a counter's average and maximum up to each row of its group; order is numeric and without ties in a group."""
    rows = df
    for name, what, how in (("__n", F.lit(1), "sum"), ("__sum", F.col(value), "sum"), ("__most", F.col(value), "max")):
        rows = ranges.before(rows, [group], order, what, name, how=how)
    return rows.withColumn("mean", (F.col("__sum") + F.col(value)) / (F.col("__n") + 1)).withColumn("most", F.greatest("__most", value)).drop("__n", "__sum", "__most")


# A small filter language: `size>=10,name==x,ratio!=inf`

_TERM = re.compile(r"^\s*(.+?)\s*(==|!=|<=|>=|<|>)\s*(.*?)\s*$")


def parse_filters(text: str) -> list[tuple[str, str, str]]:
    """(variable, operator, target) terms of a comma-separated conjunction; quotes around targets go."""
    out = []
    for term in filter(str.strip, re.findall(r"""(?:"[^"]*"|'[^']*'|[^,])+""", text)):
        if not (m := _TERM.match(term)):
            raise ValueError(f"not a filter: {term}")
        out.append((m[1], m[2], m[3].strip("'\"")))
    return out


def apply_filters(df: DataFrame, text: str) -> DataFrame:
    """Rows that meet all terms. Targets are numbers (inf too) where they read as such; NaN and null meet only !=."""
    for name, op, target in parse_filters(text):
        c = F.col(name)
        numeric = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
        t = F.lit(float(target)) if numeric else F.lit(target)
        c = c.cast("double") if numeric else c
        test = {"==": c == t, "!=": c != t, "<": c < t, "<=": c <= t, ">": c > t, ">=": c >= t}[op]
        missing = c.isNull() | F.isnan(c) if numeric else c.isNull()
        df = df.where(missing | test if op == "!=" else ~missing & test)
    return df
