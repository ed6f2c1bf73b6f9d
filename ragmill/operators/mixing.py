"""Union, interleaving, splitting, sets, and packing of token sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import seeded, seeded_int
from . import ranges


def concatenate(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """All rows with the name of their data set in _dataset_name; missing columns are null."""
    named = [df.withColumn("_dataset_name", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def numbered(df: DataFrame, by: Sequence[str], *order: Column, name: str = "row_id") -> DataFrame:
    """Gapless numbers from 0 in each group, by order. No group is sorted in one task."""
    return ranges.places(df, by, *order, name=name)


def running(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The sum of value over the earlier rows of the group, by an order column without ties. Only a range of a group is sorted in one
    task."""
    return ranges.before(df, by, order, value, name)


def interleave(df: DataFrame, source: str, order: str, strategy: str = "first_exhausted") -> DataFrame:
    """Sources in turn: turn counts from 0 for each source, place is the position in the mix (turn, then source).

    first_exhausted stops at the shortest source, all_exhausted repeats short ones to the longest's length,
    all_exhausted_without_replacement lets sources run out.
    """
    ranked = running(df, [source], order, F.lit(1), "turn")
    sizes = ranked.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    ends = sizes.agg(F.min("__n").alias("__least"), F.max("__n").alias("__most"))  # one row
    if strategy == "first_exhausted":
        return ranked.join(F.broadcast(ends)).where(F.col("turn") < F.col("__least")).drop("__least", "__most")
    if strategy == "all_exhausted":
        sized = ranked.join(sizes, source).join(F.broadcast(ends))
        again = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__most") - 1 - F.col("turn")) / F.col("__n")))
        return sized.withColumn("__again", F.explode(again)).withColumn("turn", F.col("turn") + F.col("__again") * F.col("__n")).drop("__n", "__least", "__most", "__again")
    return ranked


#: Slots of a block of a weighted mix.
SLOTS = 1 << 16


def _drawn(spark, source: str, kind: str, weights: Mapping[str, float], begin: int, end: int, seed: int) -> DataFrame:
    """slot, its block, and the source that it draws."""
    total, bound, draw = sum(weights.values()), 0.0, F.lit(list(weights)[-1])
    u = seeded_int(seed, F.col("slot")) / F.lit(float(1 << 52))
    cuts = []
    for name, w in weights.items():
        bound += w / total
        cuts.append((bound, name))
    for b, name in reversed(cuts[:-1]):
        draw = F.when(u < b, F.lit(name)).otherwise(draw)
    return spark.range(begin, end).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOTS).alias("__block")).withColumn(source, draw.cast(kind))


def _counted(drawn: DataFrame, source: str) -> DataFrame:
    """__block, source, and the draws of the source in the block and in those before: a row for each source and SLOTS slots."""
    counts = drawn.groupBy("__block", source).agg(F.count(F.lit(1)).alias("__in"))
    return counts.withColumn("__before", F.sum("__in").over(Window.partitionBy(source).orderBy("__block")) - F.col("__in"))


def _ranked(drawn: DataFrame, counts: DataFrame, source: str) -> DataFrame:
    """Adds __k, the earlier draws of the slot's source: those in its block, and the block's count of those before it."""
    at = F.row_number().over(Window.partitionBy("__block", source).orderBy("slot")) - 1
    return drawn.withColumn("__at", at).join(counts.drop("__in"), ["__block", source]).withColumn("__k", F.col("__before") + F.col("__at")).drop("__at", "__before", "__block")


def last_draws(spark, source: str, kind: str, weights: Mapping[str, float], sizes: Mapping[str, int], seed: int) -> dict[str, int]:
    """The slot in which each source gives its last row. The block that it is in is found from counts of blocks, the slot within that block
    alone; if the slots that are expected to be enough are not, twice as many are counted."""
    total = sum(weights.values())
    n = max(int(sizes[s] * total / w * 1.05) for s, w in weights.items()) + 1000
    while True:
        drawn = _drawn(spark, source, kind, weights, 0, n, seed)
        counts = _counted(drawn, source)
        size = F.coalesce(*[F.when(F.col(source) == F.lit(s), F.lit(c)) for s, c in sizes.items()])
        blocks = counts.where((F.col("__before") < size) & (F.col("__before") + F.col("__in") >= size)).select("__block", source, (size - F.col("__before")).alias("__nth")).collect()  # one for each source
        if len(blocks) == len(sizes):
            break
        n *= 2
    out = {}
    for r in blocks:
        begin = r["__block"] * SLOTS
        own = _drawn(spark, source, kind, weights, begin, min(begin + SLOTS, n), seed).where(F.col(source) == F.lit(r[source]))
        out[r[source]] = own.select("slot").orderBy("slot").limit(r["__nth"]).agg(F.max("slot")).first()[0]
    return out


def mix_by_weight(df: DataFrame, source: str, order: str, weights: Mapping[str, float], n: int | None, seed: int, *, strategy: str | None = None) -> DataFrame:
    """n slots (None: as many as there are rows), each from a source drawn by weight; a source gives its rows in order and starts again at its end.

    With a strategy the mix ends by itself and n is left out: first_exhausted once a source has given its last row, all_exhausted once all
    have, all_exhausted_without_replacement there too, and sources that have run out give no more rows. A source without rows or weight
    would never end, so it is an error.
    """
    spark, kind = df.sparkSession, df.schema[source].dataType.simpleString()
    df = df.where(F.col(source).isin(list(weights)))
    counted = df.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    sizes = {r[source]: r["__n"] for r in counted.collect()}  # one for each weight
    if missing := [s for s, w in weights.items() if not sizes.get(s) or w <= 0]:
        raise ValueError(f"no rows or no weight: {', '.join(map(str, missing))}")
    if strategy:
        if n is not None:
            raise ValueError("a strategy ends the mix, not a number of slots")
        ends = last_draws(spark, source, kind, weights, sizes, seed).values()
        n = (min(ends) if strategy == "first_exhausted" else max(ends)) + 1
    n = sum(sizes.values()) if n is None else n
    drawn = _drawn(spark, source, kind, weights, 0, n, seed)
    slots = _ranked(drawn, _counted(drawn, source), source)
    rows = running(df, [source], order, F.lit(1), "__r")
    keyed = slots.join(F.broadcast(counted), source).withColumn("__r", F.pmod("__k", F.col("__n")))  # a row for each weight
    if strategy == "all_exhausted_without_replacement":
        keyed = keyed.where(F.col("__k") < F.col("__n"))
    return keyed.join(rows, [source, "__r"]).drop("__k", "__r", "__n")


def split(df: DataFrame, key: str, validation: int | float, seed: int) -> DataFrame:
    """split: validation for the first rows in seeded order (a count, or the share of all rounded up), else train.

    The threshold is the hash of the last validation row, found by a top-n, so rows are tagged where they stand.
    """
    h = seeded(seed, F.col(key))
    if isinstance(validation, float):
        import math

        validation = math.ceil(df.count() * validation)
    if not validation:
        return df.withColumn("split", F.lit("train"))
    last = df.select(h.alias("__h")).orderBy("__h").limit(validation).agg(F.max("__h").alias("__edge"))  # one row
    return df.join(F.broadcast(last)).withColumn("split", F.when(h <= F.col("__edge"), "validation").otherwise("train")).drop("__edge")


def routes(splits: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Named splits to the trainer's names: train, validation, validation_*."""
    out = {f"{k}_dataset" if k == "train" else k.replace("validation", "eval_dataset", 1): v for k, v in splits.items() if k == "train" or k.startswith("validation")}
    if not out:
        raise ValueError("neither train nor validation among the splits")
    return out


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: both, only_a or only_b."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    where = F.when(F.col("__a").isNull(), "only_b").when(F.col("__b").isNull(), "only_a").otherwise("both")
    return x.join(y, key, "full").select(key, where.alias("found_in"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order for each key, by partial aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a log doesn't have yet."""
    return df.join(done.select(key), key, "left_anti")


# Packing


def fixed_blocks(df: DataFrame, length: str, block: int, by: Sequence[str], order: str) -> DataFrame:
    """Texts of a group laid end to end and cut into blocks: start (offset), first_block and last_block that each touches."""
    out = running(df, by, order, F.col(length), "start")
    return out.withColumn("first_block", F.floor(F.col("start") / block)).withColumn("last_block", F.floor((F.col("start") + F.col(length) - 1) / block))


def cut_blocks(df: DataFrame, ids: str, block: int, by: Sequence[str], order: str) -> DataFrame:
    """by, block and ids: the token ids of a group laid end to end in order and cut into blocks of equal length; the tail that fills none
    is dropped. Only the pieces of a block meet in one place."""
    n = F.size(ids)
    placed = running(df.where(n > 0).select(*by, order, F.col(ids).alias("__ids")), by, order, F.size("__ids"), "__start").withColumn("__n", F.size("__ids"))
    touched = F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__n") - 1) / block))
    rows = placed.withColumn("block", F.explode(touched))
    low = F.greatest(F.col("block") * block - F.col("__start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("__start"), F.col("__n"))
    piece = F.slice("__ids", (low + 1).cast("int"), (high - low).cast("int"))
    met = rows.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct(F.col("__start").alias("s"), piece.alias("x")))).alias("__p"))
    return met.select(*by, "block", F.flatten(F.transform("__p", lambda p: p["x"])).alias(ids)).where(F.size(ids) == block)


def greedy_knapsacks(df: DataFrame, length: str, capacity: int, by: Sequence[str], order: str) -> DataFrame:
    """knapsack: rows of a batch packed by taking, again and again, the longest that fits. Batches are bounded by the caller's
    grouping (the trainer packs batch by batch); rows longer than the capacity get knapsack -1."""
    import bisect

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", knapsack int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, order], kind="stable").reset_index(drop=True)
        lengths, left, out, k = pdf[length].tolist(), list(range(len(pdf))), [-1] * len(pdf), 0
        left = [i for i in left if lengths[i] <= capacity]
        while left:
            room = capacity
            while (at := bisect.bisect_right(left, room, key=lambda i: lengths[i])) > 0:
                i = left.pop(at - 1)
                out[i] = k
                room -= lengths[i]
            k += 1
        return pdf.assign(knapsack=pd.Series(out, dtype="int32"))

    return df.groupBy(*by).applyInPandas(run, kinds)


def micro_batches(df: DataFrame, length: str, budget: int, by: Sequence[str], order: str, *, padded: bool = True) -> DataFrame:
    """batch: rows of a worker's stream in order, a new batch where the next row would break the budget: longest times count if
    padded, else the sum."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", batch int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, k, n, most, total = [], 0, 0, 0, 0
        for x in pdf[length].tolist():
            cost = max(most, x) * (n + 1) if padded else total + x
            if n and cost > budget:
                k, n, most, total = k + 1, 0, 0, 0
            n, most, total = n + 1, max(most, x), total + x
            out.append(k)
        return pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int32"))

    return df.groupBy(*by).applyInPandas(run, kinds)


def packed_rows(df: DataFrame, by: Sequence[str], ids: str, labels: str, order: str, cutoff: int, pad_id: int = 0) -> DataFrame:
    """One row for each knapsack: ids, labels, position ids, sequence numbers (from 1; 0 pads) and boundaries, padded to cutoff + 1."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("x"), F.col(labels).alias("y"))))
    g = df.groupBy(*by).agg(entries.alias("__e"))
    xs, ys = F.flatten(F.transform("__e", lambda e: e["x"])), F.flatten(F.transform("__e", lambda e: e["y"]))
    places = F.flatten(F.transform("__e", lambda e: F.sequence(F.lit(0), F.size(e["x"]) - 1)))
    numbers = F.flatten(F.transform("__e", lambda e, i: F.array_repeat((i + 1).cast("int"), F.size(e["x"]))))
    sizes = F.transform("__e", lambda e: F.size(e["x"]))
    ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v), F.greatest(F.lit(cutoff + 1) - F.size(c), F.lit(0)))), 1, cutoff + 1)
    return g.select(*by, fill(xs, pad_id).alias("input_ids"), fill(ys, -100).alias("labels"), fill(places, 0).alias("position_ids"), fill(numbers, 0).alias("sequence_ids"), ends.alias("boundaries"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in seeded order."""
    return df.orderBy(seeded(seed, F.col(key)), key)


def shuffled_places(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Each row's place in the seeded order, from 0. Parts are ranges of the hash; counts of parts give each its offset, so no task sorts
    more than a part."""
    h = seeded(seed, F.col(key))
    tagged = df.withColumn("__h", h).withColumn("__part", F.substring("__h", 1, 4))
    counts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # at most 65536 rows
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key)) - 1
    return tagged.withColumn("__at", at).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__h", "__part", "__before", "__at")


def buffer_shuffled(df: DataFrame, order: str, size: int, seed: int, name: str = "place") -> DataFrame:
    """Each row's place, from 0, when buffers of `size` rows in order are shuffled by seed, one after the other. Order has no ties."""
    placed = running(df.withColumn("__g", F.lit(0)), ["__g"], order, F.lit(1), "__i").drop("__g").withColumn("__b", F.floor(F.col("__i") / size))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(seeded(seed, F.col(order)), order)) - 1
    return placed.withColumn(name, F.col("__b") * size + at).drop("__i", "__b")


def take_skip(df: DataFrame, n: int, order: str) -> tuple[DataFrame, DataFrame]:
    """The first n rows by an order without ties, and the others. The n-th value is found by a top-n; rows are split where they stand."""
    if n <= 0:
        return df.limit(0), df
    edge = df.select(order).orderBy(order).limit(n).agg(F.max(order).alias("__edge"))  # one row
    tagged = df.join(F.broadcast(edge))
    return tagged.where(F.col(order) <= F.col("__edge")).drop("__edge"), tagged.where(~F.coalesce(F.col(order) <= F.col("__edge"), F.lit(False))).drop("__edge")


def full_batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """batch and place for each row; the rows start again to fill the last batch."""
    placed = running(df.withColumn("__g", F.lit(0)), ["__g"], order, F.lit(1), "__i").drop("__g")
    whole = df.agg(F.count(F.lit(1)).alias("__all"))  # one row
    end = F.ceil(F.col("__all") / size) * size - 1
    spread = placed.join(F.broadcast(whole)).withColumn("__p", F.explode(F.sequence(F.col("__i"), end, F.col("__all"))))
    return spread.withColumn("batch", F.floor(F.col("__p") / size)).withColumn("place", F.pmod("__p", F.lit(size))).drop("__i", "__all", "__p")


def previous_in_batch(df: DataFrame, value: str, order: str, size: int = 1000) -> DataFrame:
    """mismatched: the value of the row before in its batch of `size` rows; a batch's first row gets its last value. row order
    numbers run gapless from 0."""
    batch = F.floor(F.col(order) / size)
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("mismatched", F.coalesce(F.lag(value).over(w), last))
