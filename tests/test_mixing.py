"""Weighted mixes that end by themselves, against draws made one by one."""

from __future__ import annotations

import hashlib

import pytest

from ragmill.operators import mixing


def draws(weights, seed):
    total, slot = sum(weights.values()), 0
    while True:
        u, bound = int(hashlib.md5(f"{seed}:{slot}".encode()).hexdigest()[:13], 16) / (1 << 52), 0.0
        for name, w in weights.items():
            bound += w / total
            if u < bound or name == list(weights)[-1]:
                yield name
                break
        slot += 1


def mixed(sizes, weights, seed, strategy):
    given, out = dict.fromkeys(sizes, 0), []
    for slot, s in enumerate(draws(weights, seed)):
        if given[s] < sizes[s] or strategy != "all_exhausted_without_replacement":
            out.append((slot, s, given[s] % sizes[s]))
        given[s] += 1
        done = [given[x] >= sizes[x] for x in sizes]
        if any(done) if strategy == "first_exhausted" else all(done):
            return out


@pytest.mark.parametrize("slots", [1 << 16, 37])
@pytest.mark.parametrize("strategy", ["first_exhausted", "all_exhausted", "all_exhausted_without_replacement"])
def test_ends(spark, strategy, slots, monkeypatch):
    """A source of a hundred times the size of another, and one so rare that more slots are needed than expected."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    for seed, sizes, weights in ((7, {"a": 20, "b": 2000, "c": 1}, {"a": 2.0, "b": 1.0, "c": 0.1}), (3, {"a": 40, "b": 3}, {"a": 1.0, "b": 0.001})):
        rows = [(s, i) for s, n in sizes.items() for i in range(n)] + [("of no weight", 0), (None, 1)]
        df = spark.createDataFrame(rows, "s string, i long").repartition(3)
        got = mixing.mix_by_weight(df, "s", "i", weights, None, seed, strategy=strategy).collect()
        assert sorted((r["slot"], r["s"], r["i"]) for r in got) == mixed(sizes, weights, seed, strategy)


def test_what_can_not_end(spark):
    df = spark.createDataFrame([("a", 1)], "s string, i long")
    for weights in ({"a": 1.0, "b": 1.0}, {"a": 0.0}):
        with pytest.raises(ValueError, match="no rows or no weight"):
            mixing.mix_by_weight(df, "s", "i", weights, 5, 1)
    with pytest.raises(ValueError, match="ends the mix"):
        mixing.mix_by_weight(df, "s", "i", {"a": 1.0}, 5, 1, strategy="all_exhausted")
    assert [r["i"] for r in mixing.mix_by_weight(df, "s", "i", {"a": 1.0}, 4, 1).collect()] == [1] * 4
