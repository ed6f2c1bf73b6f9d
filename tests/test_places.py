"""Places, bounded stores and samples of groups that hold most of the rows, over ranges and runs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragmill.operators import analytics, curation, ranges, telemetry


@pytest.fixture
def parts(spark):
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_places(spark, parts):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["x", "y", None]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, p string, i long").repartition(5)
    got = {r["i"]: r["place"] for r in ranges.places(df, ["g"], F.col("p").desc(), F.col("i")).collect()}
    key = lambda r: (r[1] is None, -ord(r[1] or " "), r[2])
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=key)
        assert [got[r[2]] for r in own] == list(range(len(own)))
    whole = {r["i"]: r["place"] for r in ranges.places(df, [], F.col("i")).collect()}
    assert whole == {i: i for _, _, i in rows}
    assert ranges.places(df.limit(0), ["g"], F.col("i")).count() == 0


@pytest.mark.parametrize("steps", [1 << 16, 4])
def test_bounded_store(spark, parts, steps, monkeypatch):
    monkeypatch.setattr(telemetry, "STEPS", steps)
    rnd = random.Random(steps)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([1, 1, -1])) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, i long, d int").repartition(3)
    live, want = defaultdict(int), {}
    for g, i, d in rows:
        refused = not 0 <= live[g] + d <= 3
        live[g] += 0 if refused else d
        want[i] = (live[g], 3 - live[g], refused)
    assert {r["i"]: (r["live"], r["free"], r["refused"]) for r in telemetry.live_counts(df, "g", "i", "d", 3).collect()} == want
    assert any(w[2] for w in want.values())


def test_few_shot_of_a_large_group(spark, parts):
    """Each target of a group of 3000 has three others of it; a group of two has one, a group of one none."""
    rows = [(i, "large") for i in range(3000)] + [(5000, "two"), (5001, "two"), (6000, "one")]
    df = spark.createDataFrame(rows, "k long, g string")
    got = curation.few_shot(df, df, 3, 9, key="k", pool_key="k", by="g").collect()
    by = defaultdict(list)
    for r in got:
        by[r["target_id"]].append((r["shot"], r["shot_id"]))
    group = dict(rows)
    for k, shots in by.items():
        assert [s for s, _ in sorted(shots)] == list(range(1, len(shots) + 1))
        assert len({i for _, i in shots}) == len(shots) and k not in {i for _, i in shots} and all(group[i] == group[k] for _, i in shots)
    assert Counter(len(by[k]) for k, g in rows if g == "large") == {3: 3000} and len(by[5000]) == len(by[5001]) == 1 and 6000 not in by
    used = Counter(i for k, shots in by.items() if group[k] == "large" for _, i in shots)
    assert max(used.values()) < 20 and len(used) > 2500  # draws are spread over the pool
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    start = int(hashlib.md5(b"9:17:start").hexdigest()[:13], 16) % 3000
    assert [i for _, i in sorted(by[17])] == [i for i in (order[(start + k) % 3000] for k in range(4)) if i != 17][:3]


def test_labels_and_counters(spark, parts):
    rnd = random.Random(6)
    rows = [(f"k{rnd.choice([1, 1, 1, 2])}x0", rnd.random(), i) for i in range(500)] + [("none", 1.0, 500)]
    df = spark.createDataFrame(rows, "label string, v double, i long")
    got = defaultdict(list)
    for r in analytics.grouped_by_label(df, "label", r"k(\d+)x(\d+)", ["m", "n"], "v").collect():
        got[r["m"]].append((r["place"], r["v"], r["of"]))
    for m in "12":
        want = sorted(v for label, v, _ in rows if label == f"k{m}x0")
        assert sorted(got[m]) == [(i, v, len(want)) for i, v in enumerate(want)]
    for r in analytics.running_counters(df, "label", "i", "v").collect():
        seen = [v for label, v, i in rows if label == r["label"] and i <= r["i"]]
        assert abs(r["mean"] - sum(seen) / len(seen)) < 1e-9 and r["most"] == max(seen)
