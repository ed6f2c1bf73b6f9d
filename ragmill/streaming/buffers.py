"""Buffers between a stream of rows and the batches made of them, kept in Spark's state store: a query that is killed and started again
goes on with the rows that its buffers held.

Rows of a key that come in one trigger are taken by rising row id, so the result follows from what each trigger has read. A task holds the
rows of a key of one trigger, which the source bounds (maxFilesPerTrigger), and the buffer, which its capacity bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "row_id long, batch long, place int, refused boolean"


def frame(rows: list[tuple], *columns: str) -> pd.DataFrame:
    """Keys stay Python objects, whatever string type pandas prefers: Spark takes those of any length."""
    return pd.DataFrame(rows, columns=list(columns)).astype({"grp": object})


class TokenBuffer(StatefulProcessor):
    """A first-in, first-out buffer of rows for each key, with a capacity of tokens.

    take: a batch goes out as soon as so many rows are held. budget: a batch goes out when the next row would bring it above so many
    tokens; a row that is larger than that alone is a batch of its own. What is held at the end stays in the buffer.
    """

    def __init__(self, capacity: int, *, take: int | None = None, budget: int | None = None, strict: bool = False) -> None:
        if (take is None) == (budget is None):
            raise ValueError("a buffer gives batches by rows (take) or by tokens (budget)")
        if budget is not None and budget > capacity:
            raise ValueError("a budget above the capacity is never met")
        self.capacity, self.take, self.budget, self.strict = capacity, take, budget, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "row_id long, tokens long")
        self.at = handle.getValueState("at", "batch long, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = sorted((int(i), int(n)) for pdf in rows for i, n in zip(pdf["row_id"], pdf["tokens"].fillna(0), strict=True))
        held = [tuple(x) for x in self.rows.get()] if self.rows.exists() else []
        batch, used = self.at.get() if self.at.exists() else (0, 0)
        out: list[tuple] = []

        def give(n: int) -> None:
            nonlocal batch, used
            gone = held[:n]
            out.extend((key[0], i, batch, place, False) for place, (i, _) in enumerate(gone))
            used -= sum(x for _, x in gone)
            del held[:n]
            batch += 1

        for i, n in came:
            if self.budget is not None and held and used + n > self.budget:
                give(len(held))
            if used + n > self.capacity:
                if self.strict:
                    raise ValueError(f"row {i} of {key[0]} would bring its buffer above {self.capacity} tokens")
                out.append((key[0], i, None, None, True))
                continue
            held.append((i, n))
            used += n
            if self.take is not None and len(held) == self.take:
                give(self.take)
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        self.at.update((batch, used))
        yield frame(out, "grp", "row_id", "batch", "place", "refused").astype({"batch": "Int64", "place": "Int32"})


class ShuffleBuffer(StatefulProcessor):
    """A reservoir of `size` rows for each key: once full it gives a row for each that comes. Which one follows from the seed, the key and
    the number of the row, so the stream's order follows from its input. A key that is silent for flush_ms gives all that it holds."""

    def __init__(self, size: int, seed: int, flush_ms: int | None = None) -> None:
        if size < 1:
            raise ValueError("a reservoir holds one row at least")
        self.size, self.seed, self.flush_ms = size, seed, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row_id long")
        self.at = handle.getValueState("at", "came long, given long")

    def _draw(self, key: object, n: int, below: int) -> int:
        return draw(self.seed, key, n, below)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = sorted(int(i) for pdf in rows for i in pdf["row_id"])
        held = [x[0] for x in self.rows.get()] if self.rows.exists() else []
        n, given = self.at.get() if self.at.exists() else (0, 0)
        out = []
        for i in came:
            if len(held) < self.size:
                held.append(i)
            else:
                place = self._draw(key[0], n, self.size)
                out.append((key[0], held[place], given))
                held[place] = i
                given += 1
            n += 1
        self.rows.put([(i,) for i in held])
        self.at.update((n, given))
        if self.flush_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)
        yield frame(out, "grp", "row_id", "place")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.rows.get()] if self.rows.exists() else []
        n, given = self.at.get() if self.at.exists() else (0, 0)
        out = []
        while held:
            place = self._draw(key[0], n, len(held))
            out.append((key[0], held.pop(place), given))
            n, given = n + 1, given + 1
        self.rows.clear()
        self.at.update((n, given))
        yield frame(out, "grp", "row_id", "place")


def draw(seed: int, key: object, n: int, below: int) -> int:
    """A number from 0 to below - 1 that follows from the seed, the key and n."""
    import hashlib

    return int(hashlib.md5(f"{seed}:{key}:{n}".encode()).hexdigest()[:13], 16) % below


class Window(StatefulProcessor):
    """The first `take` rows of each key after the first `skip`; take None has no end."""

    def __init__(self, skip: int, take: int | None) -> None:
        self.skip, self.take = skip, take

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = sorted(int(i) for pdf in rows for i in pdf["row_id"])
        n = self.seen.get()[0] if self.seen.exists() else 0
        low, high = max(self.skip - n, 0), len(came) if self.take is None else max(self.skip + self.take - n, 0)
        self.seen.update((n + len(came),))
        kept = came[low:high]
        yield frame([(key[0], i, n + low + place) for place, i in enumerate(kept)], "grp", "row_id", "place")


def _keyed(rows: DataFrame, key: str, row_id: str, processor: StatefulProcessor, out: str, *more: object) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    keyed = rows.select(F.col(key).alias("grp"), F.col(row_id).cast("long").alias("row_id"), *more).groupBy("grp")
    timed = "ProcessingTime" if getattr(processor, "flush_ms", None) else "None"
    return keyed.transformWithStateInPandas(processor, f"grp {kind}, {out}", "Append", timed)


def token_batches(rows: DataFrame, key: str, length: str, row_id: str, *, capacity: int, take: int | None = None, budget: int | None = None, strict: bool = False) -> DataFrame:
    """grp, row_id, batch, place, refused: rows of the batches that are full, and rows that the buffer had no room for, whose batch is null.
    strict fails the query instead of refusing."""
    processor = TokenBuffer(capacity, take=take, budget=budget, strict=strict)
    return _keyed(rows, key, row_id, processor, OUT, F.col(length).cast("long").alias("tokens"))


def shuffled_stream(rows: DataFrame, key: str, row_id: str, size: int, seed: int, *, flush_ms: int | None = None) -> DataFrame:
    """grp, row_id, place: the rows of each key as a reservoir gives them, numbered from 0. With flush_ms a query has no end of
    its own."""
    return _keyed(rows, key, row_id, ShuffleBuffer(size, seed, flush_ms), "row_id long, place long")


def window_of_stream(rows: DataFrame, key: str, row_id: str, *, skip: int = 0, take: int | None = None) -> DataFrame:
    """grp, row_id, place: rows skip to skip + take of each key, in the order in which they come."""
    return _keyed(rows, key, row_id, Window(skip, take), "row_id long, place long")


def replayed(order: list[int], size: int, seed: int, key: object, *, draw_from: Callable[[int, object, int, int], int] = draw) -> tuple[list[int], list[int]]:
    """What a reservoir gives for rows in this order, and what it holds at the end."""
    held, out = [], []
    for n, i in enumerate(order):
        if len(held) < size:
            held.append(i)
        else:
            place = draw_from(seed, key, n, size)
            out.append(held[place])
            held[place] = i
    return out, held
