"""Sharding by weighted rendezvous hashing. DataFrame functions only.

Each shard draws an exponential variate for a record, hash-driven and scaled by the shard's weight; the least draw wins.
A record's draws for the old shards stay as they are when a shard joins, so it moves only if the new one wins.

Defined results: a null key is a key of its own; a null text counts as no bytes and as the empty text's checksum; texts are read
whole, however long; equal draws go to the shard of the smaller number; repeated rows get the same shard and a slot each, rows of
one key have slots in no order; an empty table gives no rows; only the key and the text are read, so other
columns, whatever their names, have no effect and are not returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Groups of slots over all shards; bounds the table of offsets that is broadcast, whatever the input's size.
SLOT_GROUPS = 1 << 16
#: Parts that rows alike are dealt to.
SALTS = 1024


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for u uniform in (0, 1), a function of key and shard alone."""
    h = F.xxhash64(key, F.lit(shard).cast("long"))
    return -F.ln((F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(float(weight))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least draw; shards of weight 0 get no records."""
    draws = [F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*draws))["shard"]


def shard_key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))


def rendezvous_shards(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """key, size, text_crc32, shard, slot, and grown_shard: the shard under the weights in grown, null without them.

    Slots run gapless from 0 in each shard. They come from counts of (shard, hash group), whose running totals are a
    table of at most SLOT_GROUPS rows, and from row numbers within a group; no shard is sorted as a whole. Rows of one key, and rows
    repeated as a whole, are in many groups.
    """
    groups = max(1, SLOT_GROUPS // len(weights))
    k = shard_key(F.col("__key"))
    keyed = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
        "__key",
        (F.octet_length("__text").cast("long") + 8).alias("size"),
        F.crc32("__text").alias("text_crc32"),
        choose(k, weights).alias("shard"),
        (choose(k, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"),
    )
    group = F.pmod(F.xxhash64(F.lit("slot"), "__key", "text_crc32", "size", "__salt"), F.lit(groups)).cast("int")
    # Written, so that texts are read once and that counts and row numbers see the same salts.
    keyed = shared_table(keyed.select("*", group.alias("__group")).drop("__salt"), "shards")
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", "__group").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("shard", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__group").orderBy("__key", "text_crc32", "size")
    numbered = keyed.withColumn("__at", F.row_number().over(within))
    # Broadcast: at most SLOT_GROUPS rows of three numbers, under 2 MB at every input size.
    return numbered.join(F.broadcast(offsets), ["shard", "__group"]).select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("__before") + F.col("__at") - 1).alias("slot"),
        "grown_shard",
    )
