"""Line dedup over overlapping three-line windows. DataFrame functions only.

Every window of three consecutive lines is hashed (128 bits), windows that occur more than once anywhere are found, and
each occurrence but the first, by (id, line), covers its three lines. Covered lines go; what overlaps merges.

Defined results: a null text stays null and has no lines; a text of fewer than three lines has no window and stays as it
is; windows of three blank lines are no repeats; rows with equal id and equal text are one record, so all of them keep or
lose the same lines; rows that share an id (or have none) but not the text are records of their own, the one of the smaller
text hash first; a null id comes before all others; a document whose lines all go gets an empty text; texts are read whole,
however long (a text is one row, so it must fit a task); an empty table gives no rows; only the id and the text are read, so
other columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fresh, let, shared_table, text_hash

#: Lines in a window.
SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column) -> Column:
    """Two independent hashes of each window, null for a window of blank lines."""

    def one(i: Column) -> Column:
        window = F.slice(lines, i + 1, SPAN)
        blank = F.translate(F.array_join(window, ""), WHITE, "") == ""
        return F.when(~blank, F.struct(F.xxhash64(window).alias("a"), F.xxhash64(F.lit(7), window).alias("b")))

    return F.when(F.size(lines) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(lines) - SPAN), one))


def covered_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key, __hash and __gone, the sorted covered line numbers from 0, for each record that loses lines."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), text_hash(F.col(text)).alias("__hash"))
    windows = rows.select("__key", "__hash", F.posexplode(let(_lines(F.col("__text")), _windows)).alias("__at", "__w"))
    windows = windows.where("__w is not null").select("__key", "__hash", "__at", "__w.a", "__w.b")
    windows = shared_table(windows, "line-windows")
    place = F.struct("__key", "__hash", "__at")
    seen = windows.groupBy("a", "b").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Written, so that the join below shuffles both sides itself and a hot window's partition can be split.
    repeated = shared_table(seen.where("__n > 1").select("a", "b", "__first"), "line-repeats")
    later = windows.join(repeated.hint("merge"), ["a", "b"]).where(~place.eqNullSafe(F.col("__first")))
    spread = F.flatten(F.transform(F.collect_set("__at"), lambda p: F.sequence(p, p + SPAN - 1)))
    return later.groupBy("__key", "__hash").agg(F.sort_array(F.array_distinct(spread)).alias("__gone"))


def with_covered(df: DataFrame, gone: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """df with one more column, and its name: the line numbers from covered_lines, null where nothing is covered.

    Only the id, the hash and the line numbers are added to df's own columns, whatever their names.
    """
    k, h, lost = fresh(df, "gone_key", "gone_hash", "gone_lines")
    gone = gone.select(F.col("__key").alias(k), F.col("__hash").alias(h), F.col("__gone").alias(lost))
    met = df[key].eqNullSafe(gone[k]) & (text_hash(df[text]) == gone[h])
    return df.join(gone, met, "left").drop(k, h), lost


def kept_text(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers are in gone."""

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(let(_lines(text), rest))


def dedup_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text without its covered lines, n_lines, n_removed and n_spans (runs of removed lines), a row for each input row."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    both, lost = with_covered(rows, covered_lines(df, key=key, text=text), key="__key", text="__text")
    gone = F.col(lost)
    runs = F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1)))
    return both.select(
        F.col("__key").alias(key),
        kept_text(F.col("__text"), gone).alias(text),
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(_lines(F.col("__text")))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone.isNull(), 0).otherwise(runs).cast("long").alias("n_spans"),
    )
