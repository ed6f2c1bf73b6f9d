"""Stateful streams: restarts, bounds, and state that goes away, held against plain replays."""

from __future__ import annotations

import math
import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException

from ragmill.streaming import branches, buffers, streams

ROWS = "grp string, row_id long, n long"


def files(spark, folder, batches, schema):
    """One file for each batch, in this order of modification."""
    folder.mkdir(exist_ok=True)
    had = len(list(folder.iterdir()))
    for i, rows in enumerate(batches, had):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{folder}-one")
        (one,) = [p for p in os.listdir(f"{folder}-one") if p.startswith("part-")]
        os.rename(f"{folder}-one/{one}", folder / f"{i:03}.json")
        os.utime(folder / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def random_rows(seed, n, keys="aab"):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, rng.choice([1, 5, 9, 30, 70])) for i in range(n)]


def batched(rows, budget):
    """The greedy rule; the last batch of a key stays in its buffer."""
    out, held = {}, defaultdict(list)
    number = defaultdict(int)
    for g, i, n in rows:
        if held[g] and sum(x for _, x in held[g]) + n > budget:
            for place, (j, _) in enumerate(held[g]):
                out[g, j] = (number[g], place)
            number[g] += 1
            held[g] = []
        held[g].append((i, n))
    return out, {g: [tuple(x) for x in v] for g, v in held.items()}


def held_in(spark, path, variable, columns):
    rows = spark.read.format("statestore").option("stateVarName", variable).load(f"file://{path}/log").collect()
    out = defaultdict(list)
    for r in rows:
        out[r["key"][0]] += [tuple(x[c] for c in columns) for x in ([r["list_element"]] if "list_element" in r.asDict() else r["list_value"])]
    return out


def test_buffer_goes_on_after_a_stop(spark, tmp_path):
    """Half of the files, then a query stopped amid the others, then the rest: each row is in one batch, in the order of arrival."""
    rows = random_rows(1, 240)
    parts = [rows[i : i + 20] for i in range(0, 240, 20)]
    path = str(tmp_path / "out")

    def stream(more):
        return buffers.token_batches(files(spark, tmp_path / "in", more, ROWS), "grp", "n", "row_id", capacity=100, budget=90)

    first = {(r["grp"], r["row_id"]): (r["batch"], r["place"]) for r in streams.drain(stream(parts[:6]), path).collect()}
    want, left = batched([x for p in parts[:6] for x in p], 90)
    assert first == want and dict(held_in(spark, path, "rows", ("row_id", "tokens"))) == left

    out = stream(parts[6:])
    with streams.keyed_state(spark):
        q = out.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").start()
    while (q.lastProgress or {"batchId": 0})["batchId"] < 7:
        time.sleep(0.05)
    q.stop()
    assert q.lastProgress["batchId"] < 11

    got = streams.drain(out, path).collect()
    want, left = batched(rows, 90)
    assert {(r["grp"], r["row_id"]): (r["batch"], r["place"]) for r in got} == want and len(got) == len(want)
    assert dict(held_in(spark, path, "rows", ("row_id", "tokens"))) == left
    assert sorted(i for _, i, _ in rows) == sorted([i for _, i in want] + [i for v in left.values() for i, _ in v])


def test_buffer_refuses_what_it_cannot_hold(spark, tmp_path):
    rows = [("a", 1, 60), ("a", 2, 30), ("a", 3, 20), ("a", 4, 10), ("a", 5, 200), ("a", 6, None), ("b", 7, 1)]
    stream = buffers.token_batches(files(spark, tmp_path / "in", [rows[:3], rows[3:]], ROWS), "grp", "n", "row_id", capacity=100, take=3)
    got = {r["row_id"]: (r["batch"], r["place"], r["refused"]) for r in streams.drain(stream, str(tmp_path / "out")).collect()}
    assert got == {1: (0, 0, False), 2: (0, 1, False), 3: (None, None, True), 4: (0, 2, False), 5: (None, None, True)}
    strict = buffers.token_batches(files(spark, tmp_path / "in", [], ROWS), "grp", "n", "row_id", capacity=100, take=3, strict=True)
    with pytest.raises(PySparkException, match="above 100 tokens"):
        streams.drain(strict, str(tmp_path / "strict"))
    for how in ({}, {"take": 1, "budget": 2}, {"budget": 101}):
        with pytest.raises(ValueError):
            buffers.TokenBuffer(100, **how)


def test_reservoir(spark, tmp_path):
    """Streamed rows are those of a replay, before and after a restart, and the timer gives out the rest."""
    rows = random_rows(2, 90)
    parts = [rows[:30], rows[30:60], rows[60:]]
    path = str(tmp_path / "out")
    streams.drain(buffers.shuffled_stream(files(spark, tmp_path / "in", parts[:1], ROWS), "grp", "row_id", 8, 5), path)
    got = streams.drain(buffers.shuffled_stream(files(spark, tmp_path / "in", parts[1:], ROWS), "grp", "row_id", 8, 5), path).collect()
    held = held_in(spark, path, "rows", ("row_id",))
    for g in "ab":
        out, rest = buffers.replayed([i for k, i, _ in rows if k == g], 8, 5, g)
        assert [r["row_id"] for r in sorted(got, key=lambda r: r["place"]) if r["grp"] == g] == out
        assert [x[0] for x in held[g]] == rest
    flushed = streams.drain(buffers.shuffled_stream(files(spark, tmp_path / "in", [], ROWS), "grp", "row_id", 8, 5, flush_ms=500), str(tmp_path / "flush"), seconds=15).collect()
    assert sorted(r["row_id"] for r in flushed) == list(range(90))
    for g in "ab":
        own = sorted((r["place"], r["row_id"]) for r in flushed if r["grp"] == g)
        assert [p for p, _ in own] == list(range(len(own)))


def test_window(spark, tmp_path):
    rows = [("a", i, 1) for i in range(10)] + [("b", 20, 1)]
    stream = files(spark, tmp_path / "in", [rows[:4], rows[4:]], ROWS)
    got = streams.drain(buffers.window_of_stream(stream, "grp", "row_id", skip=3, take=4), str(tmp_path / "out")).collect()
    assert sorted((r["grp"], r["row_id"], r["place"]) for r in got) == [("a", i, i) for i in range(3, 7)]
    rest = streams.drain(buffers.window_of_stream(stream, "grp", "row_id", skip=1), str(tmp_path / "rest")).collect()
    assert sorted(r["row_id"] for r in rest) == list(range(1, 10))


SHARDS = "grp long, branch int, step int, logp double, prior_logit double, n_branches int, n_steps int"


def mixtures(priors, steps, top_p):
    """(step, marginal, branches) from priors and, for each step, log-probabilities by branch."""
    live, out = dict(priors), []
    for s, logps in enumerate(steps):
        total = sum(math.exp(x) for x in live.values())
        out.append((s, round(math.log(sum(math.exp(x + logps[b]) for b, x in live.items()) / total), 9), len(live)))
        live = {b: x + logps[b] for b, x in live.items()}
        total, sum_, kept = sum(math.exp(x) for x in live.values()), 0.0, {}
        for b in sorted(live, key=lambda b: (-live[b], b)):
            if kept and sum_ >= top_p:
                break
            kept[b] = live[b]
            sum_ += math.exp(live[b]) / total
        live = kept
    return out


@pytest.mark.parametrize("top_p", [1.0, 0.6])
def test_branches(spark, tmp_path, top_p):
    """One to four branches; reports in any order, repeated, of steps long given out and of branches long pruned. Nothing is left."""
    rng = random.Random(3)
    want, rows = {}, []
    for g in range(12):
        k = 1 + g % 4
        priors = {b: rng.uniform(-1, 1) for b in range(k)}
        steps = [{b: rng.uniform(-3, 0) for b in range(k)} for _ in range(3)]
        want |= {(g, s): (m, n) for s, m, n in mixtures(priors, steps, top_p)}
        rows += [(g, b, s, steps[s][b], priors[b], k, 3) for s in range(3) for b in range(k)]
    order = rows[:]
    rng.shuffle(order)
    parts = [order[i::5] for i in range(5)]
    parts[2] += parts[0][:6]  # reports that come again while their group still runs, or after it is over
    stream = branches.branch_groups(files(spark, tmp_path / "in", parts, SHARDS), top_p=top_p, late_ms=8000)
    got = streams.drain(stream, str(tmp_path / "out"), seconds=25).collect()
    assert {(r["grp"], r["step"]): (round(r["marginal"], 9), r["n_live"]) for r in got} == want and len(got) == len(want)
    assert all(r["complete"] for r in got)
    for variable in ("at", "live", "waiting"):
        assert spark.read.format("statestore").option("stateVarName", variable).load(f"file://{tmp_path}/out/log").count() == 0


def test_silent_groups(spark, tmp_path):
    """A group that never gets its third branch is given out with what it has, and forgotten."""
    rows = [(1, b, 0, -1.0 - b, 0.0, 3, 2) for b in range(2)] + [(2, 0, 0, -1.0, 0.0, 1, 2), (2, 0, 1, -2.0, 0.0, 1, 2)]
    got = streams.drain(branches.branch_groups(files(spark, tmp_path / "in", [rows], SHARDS), timeout_ms=700), str(tmp_path / "out"), seconds=12).collect()
    half = math.log((math.exp(-1) + math.exp(-2)) / 2)
    assert sorted((r["grp"], r["step"], round(r["marginal"], 9), r["n_live"], r["complete"]) for r in got) == [(1, 0, round(half, 9), 2, False), (2, 0, -1.0, 1, True), (2, 1, -2.0, 1, True)]
    assert spark.read.format("statestore").option("stateVarName", "live").load(f"file://{tmp_path}/out/log").count() == 0


def test_whole_groups_leave_state_alone():
    """A thousand groups of one bucket that come whole: the bucket is asked once whether it holds anything."""
    calls = []

    class Held:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    class Handle:
        def getMapState(self, *a):
            return Held()

    groups = branches.BranchGroups("long", 1.0, None, None)
    groups.init(Handle())
    rows = [(g, s, b, -1.0 - b, 0.0, 2, 2, 0) for s in (1, 0) for b in (1, 0) for g in range(1000)]
    out = list(groups.handleInputRows((0,), iter(rows), None))
    assert len(out) == 2000 and all(r["complete"] and r["n_live"] == 2 for r in out)
    assert calls == ["exists"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_groups_share_a_bucket(spark, tmp_path, kind):
    """Groups over several triggers in two buckets, one without an id; one never gets all its branches and stays in the state."""
    rng = random.Random(4)
    name = (lambda g: (1 << 60) + g) if kind == "long" else str
    want, rows = {}, []
    for g in range(10):
        own, k = None if g == 9 else name(g), 1 + g % 3
        priors = {b: rng.uniform(-1, 1) for b in range(k)}
        steps = [{b: rng.uniform(-3, 0) for b in range(k)} for _ in range(3)]
        want |= {(own, s): (m, n) for s, m, n in mixtures(priors, steps, 1.0)}
        rows += [(own, b, s, steps[s][b], priors[b], k, 3) for s in range(3) for b in range(k)]
    rng.shuffle(rows)
    rows.append((name(10), 0, 0, -1.0, 0.0, 2, 1))
    schema = SHARDS.replace("grp long", f"grp {kind}")
    stream = branches.branch_groups(files(spark, tmp_path / "in", [rows[i::4] for i in range(4)], schema), buckets=2)
    got = streams.drain(stream, str(tmp_path / "out")).collect()
    assert {(r["grp"], r["step"]): (round(r["marginal"], 9), r["n_live"]) for r in got} == want and len(got) == len(want)
    held = spark.read.format("statestore").option("stateVarName", "live").load(f"file://{tmp_path}/out/log").collect()
    assert len(held) == 1


def test_reports_are_packed_by_bucket():
    """A thousand reports in two buckets reach Python in two rows, and unpacked they are what they were, absent values included."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(rng.choice([None, (1 << 60) + 1, 7]), b, s, rng.choice([None, -1.0, -0.5]), 0.5, 4, 2, rng.randrange(2)) for b in range(250) for s in range(4)]
    names = ["grp", "branch", "step", "logp", "prior_logit", "n_branches", "n_steps", "bucket"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    (packed,) = branches._packed(iter([whole.slice(0, 300), whole.slice(300, 0), whole.slice(300)]))
    assert packed.num_rows == 2
    got = [t for row in packed.to_pylist() for t in zip(*[row[c] for c in names[:-1]], [row["bucket"]] * len(row["grp"]), strict=True)]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
