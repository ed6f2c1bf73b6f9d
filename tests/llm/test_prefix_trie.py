"""The trie of prefixes against one built from Python lists, with fingerprints that collide, hot keys and long conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragmill.llm import prefix_trie, queries, scans
from ragmill.llm.scans import Ring, running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TINY = {"g1": Ring(3, 7), "g2": Ring(2, 5)}


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + s[h:]
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^ \t-\r]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(p))))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df, **how).collect()), key=str)


def conversations(seed, n, longest, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in rng.sample(range(3 * n), n) for t in range(rng.randint(1, longest))]


AWKWARD = [
    (20, None, "user", "first"), (20, 0, None, None), (20, 0, "", ""), (20, 5, "user", "a\tb  c"), (21, 1, "user", "x"), (None, 0, "user", "of none"), (40, 0, "user", "same"), (40, 0, "user", "same"), (40, 0, "user", "same"),
    *[(c, t, "user", "long " * 5000 if t else "hi") for c in range(41, 60) for t in range(4)], (60, 3, "a", "bc"), (61, 3, "ab", "c"), (80, 2, "u", "q"),
]


@pytest.fixture
def ranges(spark, monkeypatch):
    """Sorts in nine ranges, however few rows; gives how many of them each scan found to begin inside a group."""
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, carried, found = {k: spark.conf.get(k) for k in conf}, [], scans._carries
    monkeypatch.setattr(scans, "_carries", lambda *a: (out := found(*a), carried.append(len(out)))[0])
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield carried
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rings", [prefix_trie.RINGS, TINY], ids=["rings", "colliding"])
def test_awkward(spark, rings):
    assert found(spark, AWKWARD, rings=rings) == brute(AWKWARD)


@pytest.mark.parametrize("seed", range(3))
def test_collisions(spark, seed):
    rows = conversations(seed, 40, 6, ["a", "b c", "d"])
    assert found(spark, rows, rings=TINY) == brute(rows)


def test_copies_and_nested_chains(spark):
    """Conversation i shares i turns with the one before it; every fifth is a copy of one conversation."""
    rows = [(20 * i, t, "user", f"{t} {min(i, t)}" if i % 5 else f"copy {t}") for i in range(18) for t in range(i + 2 if i % 5 else 7)]
    assert found(spark, rows) == brute(rows)


def test_one_long_conversation(spark, ranges):
    """A conversation that holds most of the rows is scanned in many ranges and ends in pieces of its own."""
    rows = [(0, t, "user", f"word {t % 7}") for t in range(3000)] + [(20 * c, 0, "user", "word 0") for c in range(1, 40)]
    got = {r[:2]: r for r in found(spark, rows)}
    assert min(ranges) >= 6
    assert len(got) == 3001 and got[0, 0][3] == 40 and got[0, 1][3:7] == (40, 1, 1, 39 * 2)
    assert all(got[0, d][3:7] == (1, int(d < 3000), 1, 0) for d in range(2, 3001))
    assert got[0, 1][7] == hashlib.sha256(",".join(str(20 * c) for c in range(1, 40)).encode()).hexdigest()


def test_many_copies(spark):
    """More copies than a piece holds."""
    rows = [(20 * c, 0, "user", "hi there") for c in range(5000)]
    ids = ",".join(str(20 * c) for c in range(5000))
    assert [r[2:] for r in found(spark, rows)] == [(None, 5000, 1, 1, 9998, prefix_trie.EMPTY), (0, 5000, 0, 1, 9998, hashlib.sha256(ids.encode()).hexdigest())]


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.queries()["op12_prefix_trie"](spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).collect() == []


def test_running_over_ranges(spark, ranges):
    """Sums of groups from one row to a third of all, cut anywhere."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, *range(10, 90)]), i, rng.randrange(100)) for i in range(4000)]
    ring = Ring(10, 97)
    df = spark.createDataFrame(rows, "k long, i long, v long").selectExpr("k", "i", "v as plain", "v as weighted").repartition(7)
    got = {(r["k"], r["i"]): (r["pos"], r["plain"], r["plain_before"], r["weighted"], r["weighted_before"]) for r in running(df, "k", [F.col("i")], {"plain": None, "weighted": ring}, "test").collect()}
    assert ranges[0] >= 4
    sums = defaultdict(lambda: (0, 0, 0))
    for k, i, v in sorted(rows):
        n, a, b = sums[k]
        after = (b + v * pow(10, n, 97)) % 97
        assert got[k, i] == (n, a + v, a, after, b)
        sums[k] = n + 1, a + v, after
