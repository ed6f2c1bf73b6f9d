"""Running sums of ordered groups, a group of any size: numpy scans each range of the sorted rows, and what a group has behind it when a
range begins is added afterwards. A sum may be polynomial: the term at place i of its group is weighted by base^i, modulo a prime, which
makes it a rolling fingerprint of the group's prefix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table


class Ring(NamedTuple):
    """Sums are taken modulo a prime below 2^31, so that products of two residues fit a long."""

    base: int
    modulus: int

    def powers(self, n: int) -> np.ndarray:
        """base^0 to base^(n - 1)."""
        out = np.ones(1, np.int64)
        while len(out) < n:
            out = np.concatenate((out, out * pow(self.base, len(out), self.modulus) % self.modulus))
        return out[:n]


def _scan(batch: pa.RecordBatch, before: dict, terms: dict[str, Ring | None], powers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Places and sums of a batch whose first column is the key; before is what the rows so far have left, and is brought up to date."""
    keys, n = batch.column(0).to_numpy(), batch.num_rows
    new = np.append(keys[0] != before["key"], keys[1:] != keys[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    lead = np.arange(n) < (np.argmax(new) if new.any() else n)  # rows of the group that the last batch ended in
    out = {"pos": np.arange(n) - start + np.where(lead, before["n"], 0)}
    for name, ring in terms.items():
        x = batch.column(name).to_numpy()
        if ring:
            if len(powers[name]) <= out["pos"].max():
                powers[name] = ring.powers(2 * int(out["pos"].max()) + 1024)
            x = x * powers[name][out["pos"]] % ring.modulus
        total = np.cumsum(x)
        total = total - np.where(lead, -before[name], (total - x)[start])
        out[name], out[f"{name}_before"] = (total % ring.modulus, (total - x) % ring.modulus) if ring else (total, total - x)
    segment = before["segments"] + np.cumsum(new)
    out["first"] = segment == 1
    before |= {"key": keys[-1], "n": int(out["pos"][-1]) + 1, "segments": int(segment[-1])} | {name: int(out[name][-1]) for name in terms}
    return out


def running(df: DataFrame, key: str, order: Sequence[Column], terms: dict[str, Ring | None], name: str) -> DataFrame:
    """Adds pos (from 0) to the rows of each key, and for each term, a long column, its sum up to the row in its place and that without
    the row as <term>_before. The key is a long and not null; rows alike in key and order must be alike in their terms.

    Rows are sorted by ranges of key and order, so the rows of one key may lie in many tasks. The driver reads two rows of each range.
    """
    columns = [c for c in df.columns if c not in terms]
    assert columns[0] == key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, before, powers = TaskContext.get().partitionId(), None, {"key": None, "n": 0, "segments": 0} | dict.fromkeys(terms, 0), {t: np.ones(1, np.int64) for t in terms}
        for batch in batches:
            if batch.num_rows:
                if held:
                    yield held
                found = _scan(batch, before, terms, powers)
                final = np.zeros(batch.num_rows, bool)
                arrays = [batch.column(c) for c in columns] + [pa.array(x) for x in found.values()] + [pa.array(np.full(len(final), part)), pa.array(final)]
                held = pa.RecordBatch.from_arrays(arrays, names=[*columns, *found, "part", "final"])
        if held:
            yield held.set_column(held.num_columns - 1, "final", pa.array(np.arange(held.num_rows) == held.num_rows - 1))

    sums = ", ".join(f"{t} long, {t}_before long" for t in terms)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    # Rows alike in key and order are interchangeable; a salt lets ranges part them. Written first, as the ranges' bounds take a pass of
    # their own.
    salted = shared_table(df.withColumn("__salt", F.rand(7)), f"{name}-rows")
    ranged = salted.repartitionByRange(key, *order, "__salt").sortWithinPartitions(key, *order).select(*columns, *terms)
    scanned = shared_table(ranged.mapInArrow(run, f"{kinds}, pos long, {sums}, first boolean, part long, final boolean"), name)

    carried = _carries(scanned, key, terms)
    out = scanned
    if carried:
        fields = ", ".join(f"{t}_w long, {t}_s long" for t in terms)
        table = df.sparkSession.createDataFrame(carried, f"part long, n long, {fields}").withColumn("first", F.lit(True))
        out = out.join(F.broadcast(table), ["part", "first"], "left")  # a row for each range of the sorted rows at most
        out = out.withColumn("pos", F.col("pos") + F.coalesce("n", F.lit(0)))
        for t, ring in terms.items():
            for c in (t, f"{t}_before"):
                moved = (F.col(c) * F.col(f"{t}_w") + F.col(f"{t}_s")) % ring.modulus if ring else F.col(c) + F.col(f"{t}_s")
                out = out.withColumn(c, F.when(F.col("n").isNull(), F.col(c)).otherwise(moved))
    return out.select(*columns, "pos", *[c for t in terms for c in (t, f"{t}_before")])


def _carries(scanned: DataFrame, key: str, terms: dict[str, Ring | None]) -> list[tuple]:
    """(range, rows, and for each term the weight and the sum of the rows) that earlier ranges hold of the group that a range begins with."""
    ends = scanned.where("final or (first and pos = 0)").select("part", "final", F.col("first") & (F.col("pos") == 0), key, F.col("pos") + 1, *terms).collect()
    opens = {r[0]: r[3] for r in ends if r[2]}
    out, at, n, sums = [], None, 0, dict.fromkeys(terms, 0)
    for r in sorted((r for r in ends if r[1]), key=lambda r: r[0]):
        going_on = at is not None and opens[r[0]] == at
        if going_on:
            weights = {t: pow(ring.base, n, ring.modulus) if ring else 1 for t, ring in terms.items()}
            out.append((r[0], n, *[x for t in terms for x in (weights[t], sums[t])]))
        if going_on and r[3] == at:
            sums = {t: (sums[t] + weights[t] * r[t]) % (terms[t].modulus if terms[t] else 1 << 63) for t in terms}
            n += r[4]
        else:
            at, n, sums = r[3], r[4], {t: r[t] for t in terms}
    return out
