"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it any number of times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seeded(seed: int | str, *parts: Column) -> Column:
    """A hash order that any engine can repeat: md5 of seed and parts joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_int(seed: int | str, *parts: Column) -> Column:
    """A non-negative 52-bit number from the seeded hash."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 13), 16, 10).cast("bigint")


def first_text(*candidates: Column) -> Column:
    """The first candidate that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def first_number(*candidates: Column, zero_is_missing: bool = False) -> Column:
    """The first candidate that reads as a number."""
    read = [F.expr("null").cast("double") if c is None else c.try_cast("double") for c in candidates]
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) if zero_is_missing else c for c in read])


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def best_of(*scores: Column) -> Column:
    """The greatest of several scores, missing ones aside; null if all are."""
    return F.greatest(*scores)


def top_p_for(k: Column) -> Column:
    """The share that K branches are pruned to: 1 - 1 / (2 K)."""
    return F.lit(1.0) - F.lit(1.0) / (F.lit(2.0) * k)


def user_count(configured: Column | None, request_rate: Column, observed_peak: Column) -> Column:
    """Users of a run: as configured, else its request rate, else the observed peak; zero is missing."""
    return first_number(configured, request_rate, observed_peak, zero_is_missing=True)


def device_count(direct: Column | None, *sizes: Column) -> Column:
    """Devices of a run: as given, else the product of its parallel sizes, of which missing and zero ones count as one."""
    product = F.lit(1.0)
    for s in sizes:
        product = product * F.coalesce(first_number(s, zero_is_missing=True), F.lit(1.0))
    return F.coalesce(first_number(direct, zero_is_missing=True), product)
