"""The packing plan at its production settings: whole, gapless, close to what is possible, never behind best-fit."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from ragmill.llm import packing

from .test_brute_force import check_places, lower_bound


def best_fit_decreasing(hist, capacity):
    rooms = []
    for s in sorted((s for s, n in hist.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= s), default=None)
        if fit is None:
            rooms.append(capacity - s)
        else:
            rooms.remove(fit)
            rooms.append(fit - s)
    return len(rooms)


def places(hist, capacity, groups):
    out, ranks = [], defaultdict(list)
    for r in packing.plan(hist, capacity, groups):
        for x in range(r.low, r.high):
            out.append((r.first + (x - r.low) // r.each, r.offset + (x - r.low) % r.each * r.length, r.length))
            ranks[r.length].append(x)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in hist.items()}
    return out


HISTOGRAMS = {
    "uniform": lambda g: g.integers(1, 2049, 1500),
    "log-normal": lambda g: np.exp(g.normal(5.3, 0.9, 1500)).clip(1, 2048).astype(int),
    "middling": lambda g: g.integers(260, 900, 1500),
    "halves": lambda g: g.integers(700, 1400, 600),
    "full": lambda g: np.where(g.random(900) < 0.5, 2048, g.integers(1, 300, 900)),
    "few": lambda g: g.choice([1400, 690, 640, 333, 20], 900),
    "small": lambda g: g.integers(1, 60, 900),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
@pytest.mark.parametrize("groups", [4, packing.GROUPS])
def test_plan_at_production_settings(name, groups):
    hist = dict(Counter(HISTOGRAMS[name](np.random.default_rng(11)).tolist()))
    used = check_places(places(hist, packing.CAPACITY, groups), packing.CAPACITY)
    assert lower_bound(hist, 2048) <= used <= best_fit_decreasing(hist, 2048)


def test_linear_program():
    """Fractional optimum against the least over all configurations, by their duals: no configuration is worth more than one."""
    rnd = random.Random(4)
    for _ in range(10):
        sizes = sorted(rnd.sample(range(15, 100), 5), reverse=True)
        demand = [rnd.randint(1, 40) for _ in sizes]
        chosen = [(c, t) for c, t in packing.configurations(sizes, demand, 100) if t > 1e-9]
        assert all(sum(s * k for s, k in zip(sizes, c, strict=True)) <= 100 for c, _ in chosen)
        for i, d in enumerate(demand):
            assert abs(sum(c[i] * t for c, t in chosen) - d) < 1e-6
        # Any feasible duals bound the program from below; the best of many random ones, scaled, come near but never above.
        every = [c for r in range(1, 7) for c in combinations_with_replacement(range(5), r) if sum(sizes[i] for i in c) <= 100]
        total = sum(t for _, t in chosen)
        for _ in range(300):
            y = [rnd.random() * s for s in sizes]
            worth = max(sum(y[i] for i in c) for c in every)
            assert sum(a * d for a, d in zip(y, demand, strict=True)) / worth <= total + 1e-6
        whole = best_fit_decreasing(dict(zip(sizes, demand, strict=True)), 100)
        assert total <= whole + 1e-6


def test_knapsack():
    rnd = random.Random(6)
    for _ in range(20):
        sizes, values = np.array(sorted(rnd.sample(range(12, 90), 4), reverse=True)), np.array([rnd.random() for _ in range(4)])
        every = [c for r in range(0, 9) for c in combinations_with_replacement(range(4), r) if sum(sizes[list(c)]) <= 100]
        value, counts = packing.best_configuration(sizes, values, 100)
        assert abs(value - max(sum(values[list(c)]) for c in every)) < 1e-9
        assert (counts * sizes).sum() <= 100 and abs((counts * values).sum() - value) < 1e-9
