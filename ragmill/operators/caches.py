"""Replay of accesses through a bounded cache: which of them hit, under an eviction policy.

A cache's accesses are a sequence, so a cache is replayed in one task; there are as many tasks as caches.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame


class Recent:
    """Least recently used goes first."""

    def __init__(self, capacity: int):
        self.capacity, self.kept = capacity, OrderedDict()

    def access(self, key) -> bool:
        hit = key in self.kept
        self.kept[key] = None
        self.kept.move_to_end(key)
        if len(self.kept) > self.capacity:
            self.kept.popitem(last=False)
        return hit


class Adaptive:
    """Adaptive replacement (Megiddo and Modha, 2003): keys met once and keys met again are kept in lists of their own, whose shares follow
    the hits among the keys that either has lately given up."""

    def __init__(self, capacity: int):
        self.capacity, self.target = capacity, 0.0
        self.once, self.again, self.gone_once, self.gone_again = (OrderedDict() for _ in range(4))

    def _make_room(self, key) -> None:
        over = len(self.once) > self.target or (key in self.gone_again and len(self.once) == self.target)
        kept, gone = (self.once, self.gone_once) if self.once and over else (self.again, self.gone_again)
        if kept:
            gone[kept.popitem(last=False)[0]] = None

    def access(self, key) -> bool:
        if key in self.once or key in self.again:
            self.once.pop(key, None)
            self.again.pop(key, None)
            self.again[key] = None
            return True
        a, b = len(self.gone_once), len(self.gone_again)
        if key in self.gone_once or key in self.gone_again:
            if key in self.gone_once:
                self.target = min(self.capacity, self.target + max(1.0, b / a))
            else:
                self.target = max(0.0, self.target - max(1.0, a / b))
            self._make_room(key)
            self.gone_once.pop(key, None)
            self.gone_again.pop(key, None)
            self.again[key] = None
            return False
        if len(self.once) + a == self.capacity:
            if len(self.once) < self.capacity:
                self.gone_once.popitem(last=False)
                self._make_room(key)
            else:
                self.once.popitem(last=False)
        elif (total := len(self.once) + len(self.again) + a + b) >= self.capacity:
            if total >= 2 * self.capacity and self.gone_again:
                self.gone_again.popitem(last=False)
            self._make_room(key)
        self.once[key] = None
        return False


POLICIES: dict[str, Callable] = {"lru": Recent, "arc": Adaptive}


def replay(accesses: DataFrame, by: Sequence[str], order: str, key: str, capacity: int, policy: str = "lru") -> DataFrame:
    """Adds hit: whether the key is in its cache when it is asked for."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in accesses.schema) + ", hit boolean"
    make = POLICIES[policy]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, cache = pdf.sort_values(order, kind="stable"), make(capacity)
        return pdf.assign(hit=[cache.access(k) for k in pdf[key].tolist()])

    return accesses.groupBy(*by).applyInPandas(run, kinds)
