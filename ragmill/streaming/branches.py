"""Branch groups: the branches of a request report their log-probabilities step by step, in any order; a step's mixture is given out once
all live branches have reported it, the posterior moves on, and branches of little weight are pruned.

State is a map of live branches, a map of reports that are still waited with, and where the group stands, each by group. It is taken back
as it is used: a report goes with its step, a branch when it is pruned, all of a group with its last step.

Groups are dealt to buckets, which are the keys of the stream: a call for a bucket costs as much as a call for a group would. A task holds
the rows of a bucket of one trigger, which the source bounds (maxFilesPerTrigger). Python is given rows cell by cell, so before they are
shuffled a task's reports for one bucket are put into one row, as lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Buckets that groups are dealt to.
BUCKETS = 4096

#: Reports that a task packs at once.
PACK = 100_000

Out = Row("grp", "step", "marginal", "n_live", "complete")


def logsumexp(xs: list[float]) -> float:
    top = max(xs)
    return top if math.isinf(top) else top + math.log(sum(math.exp(x - top) for x in xs))


def surviving(scores: dict[int, float], top_p: float) -> dict[int, float]:
    """The likeliest branches that hold top_p of the posterior together; ties by branch; one at least."""
    total, sum_, kept = logsumexp(list(scores.values())), 0.0, {}
    for branch, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if kept and sum_ >= top_p:
            break
        kept[branch] = score
        sum_ += math.exp(score - total)
    return kept


class BranchGroups(StatefulProcessor):
    """Rows of a bucket of groups: grp, branch, step, logp, prior_logit, and n_branches and n_steps, the same in all rows of a group.

    Of reports repeated for a branch and step the first counts (in one trigger: the smaller logp); reports of steps already given out and of
    pruned branches are left. late_ms keeps a finished group's mark for so long, so that its late reports don't begin it anew;
    timeout_ms gives out what a silent group has, complete false, and forgets it.

    What reads and writes state is a call to the JVM, so a bucket that holds nothing is asked once, and a group that comes whole in one
    trigger is neither read nor written.
    """

    def __init__(self, kind: str, top_p: float, timeout_ms: int | None, late_ms: int | None) -> None:
        self.kind, self.top_p, self.timeout_ms, self.late_ms = kind, top_p, timeout_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = f"grp {self.kind}"
        self.live = handle.getMapState("live", key, "branches array<int>, scores array<double>")
        self.waiting = handle.getMapState("waiting", key, "steps array<int>, branches array<int>, logps array<double>")
        self.at = handle.getMapState("at", key, "step int, done boolean, due long")

    def _load(self, grp: object) -> tuple[dict[int, float], dict[int, dict[int, float]]]:
        live = dict(zip(*(self.live.getValue((grp,)) or ((), ())), strict=True))
        steps: dict[int, dict[int, float]] = {}
        for s, b, x in zip(*(self.waiting.getValue((grp,)) or ((), (), ())), strict=True):
            steps.setdefault(s, {})[b] = x
        return live, steps

    def _forget(self, grp: object) -> None:
        for state in (self.live, self.waiting, self.at):
            state.removeKey((grp,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came: dict[object, list[tuple]] = {}
        for grp, s, b, x, prior, n_branches, n_steps, _ in rows:
            came.setdefault(grp, []).append((s, b, math.nan if x is None else x, math.nan if prior is None else prior, n_branches, n_steps))
        empty = not self.at.exists()
        now = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms or self.late_ms else 0
        due: set[int] = set()
        for grp, reports in came.items():
            at = None if empty else self.at.getValue((grp,))
            step, done, _ = at or (0, False, None)
            if done:
                continue
            live, steps = self._load(grp) if at else ({}, {})
            known = dict(live), {s: dict(of) for s, of in steps.items()}
            reports.sort()
            n_branches, n_steps = reports[0][4:]
            for s, b, x, prior, *_ in reports:
                if s < step or s >= n_steps or (step and b not in live):
                    continue
                live.setdefault(b, prior)
                steps.setdefault(s, {}).setdefault(b, x)
            while step < n_steps and (len(live) == n_branches if step == 0 else True) and len(got := steps.get(step, {})) == len(live):
                yield Out(grp, step, _marginal(live, got), len(live), True)
                live = surviving({b: score + got[b] for b, score in live.items()}, self.top_p)
                del steps[step]
                step += 1
                steps = {s: {b: x for b, x in of.items() if b in live} for s, of in steps.items()}
            ms = self.late_ms if step == n_steps else self.timeout_ms
            if ms:
                due.add(now + ms)
            if step < n_steps:
                self._store(grp, known, live, {s: of for s, of in steps.items() if of})
                self.at.updateValue((grp,), (step, False, now + ms if ms else None))
                continue
            if at:
                self._forget(grp)
            if ms:
                self.at.updateValue((grp,), (step, True, now + ms))
        for x in due:
            self.handle.registerTimer(x)

    def _store(self, grp: object, known: tuple[dict, dict], live: dict[int, float], steps: dict[int, dict[int, float]]) -> None:
        """Only what has changed is written."""
        if live != known[0]:
            self.live.updateValue((grp,), (list(live), list(live.values())))
        if steps != known[1]:
            held = [(s, b, x) for s, of in steps.items() for b, x in of.items()]
            if held:
                self.waiting.updateValue((grp,), tuple(map(list, zip(*held, strict=True))))
            else:
                self.waiting.removeKey((grp,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        """A group's time is in its mark: a timer of the bucket finds the groups that have not reported since, and no others."""
        by = expiredTimerInfo.getExpiryTimeInMs()
        for grp, done in [(grp, done) for (grp,), (_, done, due) in self.at.iterator() if due is not None and due <= by]:
            live, steps = ({}, {}) if done else self._load(grp)
            for s in sorted(steps):
                if got := {b: x for b, x in steps[s].items() if b in live}:
                    yield Out(grp, s, _marginal({b: live[b] for b in got}, got), len(got), False)
                    live |= {b: live[b] + x for b, x in got.items()}
            self._forget(grp)


class PackedBranchGroups(BranchGroups):
    """The same over rows of lists, as _packed makes them."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        return super().handleInputRows(key, chain.from_iterable(zip(*row[:-1], [row[-1]] * len(row[0]), strict=True) for row in rows), timerValues)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of so many reports at a time those of a bucket in one row: a list for each column, then the bucket."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("bucket")
        bucket = table["bucket"].to_numpy()
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(first, len(bucket)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(c.chunks)) for c in table.columns[:-1]]
        return pa.RecordBatch.from_arrays([*lists, pa.array(bucket[first], pa.int32())], table.column_names)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def _marginal(live: dict[int, float], got: dict[int, float]) -> float:
    order = sorted(live)  # sums are taken by branch, whatever the order of arrival
    return logsumexp([live[b] + got[b] for b in order]) - logsumexp([live[b] for b in order])


def branch_groups(shards: DataFrame, *, top_p: float = 1.0, timeout_ms: int | None = None, late_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """grp, step, marginal, n_live (branches in the mixture), complete, from grp, branch, step, logp, prior_logit, n_branches, n_steps. With a
    time, a query has no end of its own, so batch jobs leave both out."""
    kind = shards.schema["grp"].dataType.simpleString()
    rows = shards.select(
        "grp", *[F.col(c).cast("int").alias(c) for c in ("step", "branch")], *[F.col(c).cast("double").alias(c) for c in ("logp", "prior_logit")], *[F.col(c).cast("int").alias(c) for c in ("n_branches", "n_steps")],
        F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    out = f"grp {kind}, step int, marginal double, n_live int, complete boolean"
    packed = rows.mapInArrow(_packed, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema[:-1]) + ", bucket int")
    return packed.groupBy("bucket").transformWithState(PackedBranchGroups(kind, top_p, timeout_ms, late_ms), out, "Append", "ProcessingTime" if timeout_ms or late_ms else "None")
