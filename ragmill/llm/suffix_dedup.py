"""Removal of repeated byte strings with two-stage suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts earlier: in a document of smaller id, or earlier in its own.

How the one suffix array of a corpus is dealt to tasks. Each window of SPAN bytes has an anchor: the leftmost least hash among
its GRAM-byte grams, a function of the window alone. So equal windows have equal anchors, and suffixes can be sorted anchor by
anchor. A document's windows form runs with a common anchor place; a run's segment is the bytes that its windows cover.

1. `_anchors`: the runs of each text: anchor hash, segment hash, place. Runs whose segment has been met in the same task are
   repeats in whole and leave as byte ranges, so a hot passage leaves a task once.
2. `_sorted_runs`: runs meet by anchor. Later equal segments are repeats in whole. Segments that share an anchor but differ go on,
   one for each distinct segment.
3. `_suffix_ranges`: the bytes of those segments are fetched and a suffix array is built over each bucket of anchors in two
   stages: suffixes smaller than their successors are sorted directly, the rest is induced by scans over the buckets of first
   bytes. Neighbours with a common prefix of SPAN bytes or more repeat each other.
   Anchors with more than HOT distinct segments are dealt on by their windows' own 128-bit hashes instead, each window once for
   a task, so no task gathers such an anchor.
4. `_remains`: each document's ranges are merged and its remaining bytes hashed.

Hash equality stands for equality of segments: 64 bits of the segment among segments that share an anchor, its length included
(a segment has at most 2 * SPAN - GRAM bytes), or 128 bits of a window where anchors are dealt on by windows.

How much comes through the suffix arrays: repeats of whole segments (exact copies, and all of a passage but its first and last
windows) are found in steps 1 and 2 by hash, before any suffix is sorted; the windows where copies begin, end or differ, whose
segments share an anchor without being equal, come from the arrays, which are the costliest step.

Ids are integers. A document is a row's id and text. Defined results: a null text has no bytes; texts below SPAN bytes stay
whole; texts of any length are read in blocks; a null id sorts before all others; repeated rows (equal id and text) are one
document, so all of them lose the same bytes; rows that share an id (or have none) but not the text are documents of their own,
in the order of their texts' SHA-256; an empty table gives no rows; only the id and the text are read, so other columns have no
effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SPAN = 100
GRAM = 24
#: Distinct segments of an anchor that one task sorts.
HOT = 20_000
#: Bytes of text hashed together, and bytes of segments sorted together.
BLOCK, SORTED = 1 << 19, 1 << 20
#: Parts that the runs of an anchor are dealt to where they meet the table of hot anchors.
SALTS = 32
#: Runs that a task holds before it emits them.
HELD = 1_500_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_BASE = 0x5851F42D4C957F2D  # 5 modulo 8
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    if size not in _powers:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            made.append(p)
        _powers[size] = tuple(made)
    return _powers[size]


def _mix(x: np.ndarray, c: np.uint64) -> np.ndarray:
    x = x * c
    x ^= x >> np.uint64(32)
    return x


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: for each run of windows with one anchor, the anchor's hash, the segment's hash, the index of
    the document, the first window's place in the data and how many windows."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < SPAN:
        return none
    w = words8(data)
    h = _mix(w[:-16], _C[0]) * _C[1]
    h += _mix(w[8:-8], _C[2])
    h *= _C[0]
    h += _mix(w[16:], _C[3])
    h = _mix(_mix(h, _C[1]), _C[2])
    width = SPAN - GRAM + 1
    least, at, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < width:  # leftmost least of windows that double in width
        d = min(have, width - have)
        left = least[:-d] <= least[d:]
        at = np.where(left, at[:-d], at[d:])
        least = np.where(left, least[:-d], least[d:])
        have += d
    valid = np.zeros(len(at) + 1, np.int8)
    fits = ends - starts >= SPAN
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, ends[fits] - SPAN + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    first = ok.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first[starts[(starts < len(first)) & fits]] = True
    s = np.flatnonzero(first)
    if not len(s):
        return none
    doc = np.searchsorted(starts, s, side="right") - 1
    n = np.minimum(np.append(s[1:], len(at)), ends[doc] - SPAN + 1) - s
    power, inverse = _power_tables(len(w) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(_mix(w, _C[3]), _C[1]) * power[: len(w)])))
    g = (total[s + n + SPAN - 8] - total[s]) * inverse[s] + n.astype(np.uint64) * _C[2]
    return h[at[s]], _mix(_mix(g, _C[0]), _C[3]), doc, s, n


def _blocks(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """runs_of for texts of any length: ids, anchor, segment, place in the document, windows."""
    group: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        a, g, doc, s, n = runs_of(np.frombuffer(b"".join([texts[i] for i in group]), np.uint8), starts, ends)
        return ids[np.array(group)][doc], a, g, s - starts[doc], n

    for i, t in enumerate(texts):
        if len(t) > 2 * BLOCK:  # windows from each block of the text, by their start
            for b in range(0, len(t) - SPAN + 1, BLOCK):
                part = np.frombuffer(t[b : b + BLOCK + SPAN - 1], np.uint8)
                a, g, doc, s, n = runs_of(part, np.array([0]), np.array([len(part)]))
                yield ids[np.full(len(doc), i)], a, g, s + b, n
        elif len(t) >= SPAN:
            group.append(i)
            size += len(t)
            if size >= BLOCK:
                yield flush()
                group, size = [], 0
    if group:
        yield flush()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges of each document, sorted and merged where they overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    lift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 2)  # so that one running maximum serves all documents
    reach = np.maximum.accumulate(end + lift)
    first = np.concatenate(([True], (start + lift)[1:] > reach[:-1]))
    at = np.flatnonzero(first)
    return doc[at], start[at], (reach - lift)[np.append(at[1:], len(doc)) - 1]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, g, doc, pos: runs, pos = place * 128 + windows; repeats within the task as ranges, pos = -1 - end and g the start."""
    held: list[tuple[np.ndarray, ...]] = []

    def emit() -> Iterator[pa.RecordBatch]:
        doc, a, g, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((s, doc, g, a))
        doc, a, g, s, n = (x[order] for x in (doc, a, g, s, n))
        keep = np.concatenate(([True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])))
        lead = np.flatnonzero(keep)[np.cumsum(keep) - 1]
        later = (doc != doc[lead]) | (s != s[lead])  # the same place again is a repeated row, no repeat of its text
        rd, rs, re = merged(doc[later], s[later], (s + n + SPAN - 1)[later])
        columns = [np.concatenate(x) for x in ((a[keep].view(np.int64), rd * 0x2545F4914F6CDD1D), (g[keep].view(np.int64), rs), (doc[keep], rd), ((s * 128 + n)[keep], -1 - re))]
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["a", "g", "doc", "pos"])

    count = 0
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for found in _blocks(batch.column(0).to_numpy(zero_copy_only=False), texts):
            held.append(found)
            count += len(found[0])
            if count > HELD:
                yield from emit()
                held.clear()
                count = 0
    if count:
        yield from emit()


_EVENTS = "kind int, a long, doc long, s long, e long"


def _events(kind: int, a: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x) for x in (a, doc, s, e))], names=["kind", "a", "doc", "s", "e"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads runs sorted by a, g, doc, pos. Yields ranges to remove (kind 0: s, e) and one run for each distinct segment of an
    anchor that has several (kind 1: first window s, windows e). Keeps two rows from batch to batch, however large a group is."""
    lead = pending = None  # the first row of the segment met last; that row again while its anchor has no other, and whether it has
    for batch in batches:
        a, g, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if (cut := pos < 0).any():
            yield _events(0, doc[cut], doc[cut], g[cut], -1 - pos[cut])
            a, g, doc, pos = (x[~cut] for x in (a, g, doc, pos))
        if not len(a):
            continue
        if lead is not None:
            a, g, doc, pos = (np.concatenate(([x], y)) for x, y in zip(lead, (a, g, doc, pos), strict=True))
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])))
        at = np.flatnonzero(first)
        own = at[np.cumsum(first) - 1]
        later = ~first & ((doc != doc[own]) | (pos != pos[own]))
        s, n = pos >> 7, pos & 127
        if later.any():
            yield _events(0, a[later], doc[later], s[later], (s + n + SPAN - 1)[later])
        before = np.concatenate(([pending is True], a[at[1:]] == a[at[:-1]]))  # an earlier segment has this anchor
        after = np.append(a[at[1:]] == a[at[:-1]], False)
        several = before | after
        if pending is True:
            several[0] = False  # it has gone out
        send = at[several]
        if len(send):
            yield _events(1, a[send], doc[send], s[send], n[send])
        k = at[-1]
        pending = bool(before[-1])  # whether the last segment's run has gone out
        lead = (a[k], g[k], doc[k], pos[k])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (numbers; 0 ends a segment) in order, exact to depth numbers or to the segment's end.

    Stage one sorts the suffixes smaller than their successors directly; stage two scans the buckets of first numbers upward and
    induces the others from the suffixes one place on.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32), append=-1))
    known = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    small = step[following] > 0  # smaller than its successor
    ends = text == 0
    direct = np.flatnonzero(small & ~ends)
    padded = np.concatenate((text, np.zeros(depth + 16, text.dtype)))
    packed = words7(padded)
    order = np.lexsort([packed[direct + k] for k in range((depth - 1) // 7 * 7, -1, -7)])
    direct = direct[order]
    induced = ~small & ~ends
    highest = int(text.max(initial=0))
    cut = np.searchsorted(text[direct], np.arange(highest + 2))
    arriving: list[list[np.ndarray]] = [[] for _ in range(highest + 1)]
    out = []
    for c in range(highest + 1):
        if c == 0:
            bucket = [np.flatnonzero(ends)]
        else:
            wave = np.concatenate(arriving[c]) if arriving[c] else np.zeros(0, np.int64)
            arriving[c], bucket = [], []
            while len(wave):
                bucket.append(wave)
                before = wave[wave > 0] - 1
                wave = before[induced[before] & (text[before] == c)]
            bucket.append(direct[cut[c] : cut[c + 1]])
        here = np.concatenate(bucket)
        out.append(here)
        before = here[here > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            heads = text[before]
            by = np.argsort(heads, kind="stable")
            heads, before = heads[by], before[by]
            new = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
            for lo, hi in zip(new, np.append(new[1:], len(heads)), strict=True):
                arriving[heads[lo]].append(before[lo:hi])
    return np.concatenate(out)


def words7(text: np.ndarray) -> np.ndarray:
    """Seven numbers below 512 from each place on as one, the first highest."""
    x1 = text.astype(np.uint64)
    x2 = (x1[:-1] << np.uint64(9)) | x1[1:]
    x4 = (x2[:-2] << np.uint64(18)) | x2[2:]
    return (x4[:-3] << np.uint64(27)) | (x2[4:-1] << np.uint64(9)) | x1[6:]


def repeated_windows(segments: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges (doc, start, end) of the windows in segments that also start earlier in them, by suffix array."""
    lengths = np.array([len(x) for x in segments])
    text = np.zeros(int(lengths.sum()) + len(segments), np.uint16)
    begin = np.cumsum(lengths + 1) - lengths - 1
    text[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    room = (begin + lengths)[owner] - np.arange(len(text))
    order = suffix_array(text, SPAN)
    order = order[room[order] >= SPAN]
    packed = words7(np.concatenate((text, np.zeros(8, text.dtype))))
    equal = np.arange(max(0, len(order) - 1))
    for k in (*range(0, SPAN - 6, 7), SPAN - 7):  # adjacent common prefixes, dropped as soon as they end
        equal = equal[packed[order[equal] + k] == packed[order[equal + 1] + k]]
    if not len(equal):
        return doc[:0], start[:0], start[:0]
    same = np.zeros(len(order), bool)
    same[equal + 1] = True
    run = np.cumsum(~same)
    many = same.copy()
    many[:-1] |= same[1:]
    order, run = order[many], run[many]
    d, s = doc[owner[order]], start[owner[order]] + order - begin[owner[order]]
    by = np.lexsort((s, d, run))
    d, s, run = d[by], s[by], run[by]
    head = np.concatenate(([True], run[1:] != run[:-1]))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[lead]) | (s != s[lead])
    return merged(d[later], s[later], s[later] + SPAN)


_SEGMENTS = "b long, w long, doc long, s long, e long, seg binary"
_SEGMENT_KINDS = [pa.int64()] * 5 + [pa.binary()]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads doc, text and its runs (a, s, n, hot). Yields each run's segment under its anchor (b); of hot anchors each window under
    its hashes (b, w), or as a range (e) if the task has met that window before."""
    met: dict[tuple[int, int], tuple[int, int]] = {}
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT_KINDS, strict=True)], names=["b", "w", "doc", "s", "e", "seg"])

    for batch in batches:
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_py() or b""
            for r in runs:
                a, s, n = r["a"], r["s"], r["n"]
                if not r["hot"]:
                    rows.append((a, None, doc, s, None, data[s : s + n + SPAN - 1]))
                    continue
                for x in range(s, s + n):
                    two = hashlib.blake2b(data[x : x + SPAN], digest_size=16).digest()
                    w = int.from_bytes(two[:8], "little", signed=True), int.from_bytes(two[8:], "little", signed=True)
                    if len(met) > HELD:
                        met.clear()
                    first = met.setdefault(w, (doc, x))
                    if first < (doc, x):
                        rows.append((a ^ doc, None, doc, x, x + SPAN, None))
                    else:
                        rows.append((*w, doc, x, None, None))
                        met[w] = (doc, x)
            if len(rows) > 20_000:
                yield done()
                rows = []
    if rows:
        yield done()


def _suffix_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads what _segments yields, sorted by b, w, doc, s. Sorts the suffixes of whole anchors together, about SORTED bytes at a time."""
    b_at, doc_at, s_at, seg_at, size = None, [], [], [], 0
    window = lead = None

    def done() -> pa.RecordBatch:
        d, x, y = repeated_windows(seg_at, np.array(doc_at, np.int64), np.array(s_at, np.int64))
        return _events(0, d, d, x, y)

    for batch in batches:
        plain: list[tuple[int, int, int]] = []
        for b, w, doc, s, e, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seg is not None:
                if size >= SORTED and b != b_at:
                    yield done()
                    doc_at, s_at, seg_at, size = [], [], [], 0
                b_at = b
                doc_at.append(doc)
                s_at.append(s)
                seg_at.append(seg)
                size += len(seg)
            elif e is not None:
                plain.append((doc, s, e))
            elif window == (b, w):
                if lead != (doc, s):
                    plain.append((doc, s, s + SPAN))
            else:
                window, lead = (b, w), (doc, s)
        if plain:
            d, x, y = (np.array(c, np.int64) for c in zip(*plain, strict=True))
            yield _events(0, d, d, x, y)
    if seg_at:
        yield done()


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        ranges = batch.column(2)
        for i, x in enumerate(batch.column(1)):
            data, gone = x.as_py() or b"", ranges[i].as_py() or []
            spans: list[list[int]] = []
            for r in sorted((r["s"], r["e"]) for r in gone):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"s": a, "e": b} for a, b in spans]))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def removed_ranges(rows: DataFrame) -> DataFrame:
    """doc, s, e: byte ranges to remove, not merged, from rows of doc (long, not null) and text (binary)."""
    met = rows.mapInArrow(_anchors, "a long, g long, doc long, pos long").repartition("a").sortWithinPartitions("a", "g", "doc", "pos")
    events = shared_table(met.mapInArrow(_sorted_runs, _EVENTS), "runs")
    open_runs = events.where("kind = 1").select("a", "doc", "s", F.col("e").alias("n"))
    hot = open_runs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT)
    # Each hot anchor once for each salt, so that its runs meet it in as many tasks.
    hot = shared_table(hot.select("a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hot")), "hot-anchors")
    salted = open_runs.withColumn("salt", F.pmod(F.xxhash64("doc", "s"), F.lit(SALTS)).cast("int"))
    marked = salted.join(hot, ["a", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy("doc").agg(F.collect_list(F.struct("a", "s", "n", "hot")).alias("runs"))
    fetched = rows.join(wanted.hint("merge"), "doc").select("doc", "text", "runs")
    dealt = fetched.mapInArrow(_segments, _SEGMENTS).repartition("b", "w").sortWithinPartitions("b", "w", "doc", "s")
    sorted_ranges = dealt.mapInArrow(_suffix_ranges, _EVENTS)
    return events.where("kind = 0").select("doc", "s", "e").unionByName(sorted_ranges.select("doc", "s", "e"))


LOWEST = -(1 << 63)


def _documents(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """doc (long) and text (binary), and what doc stands for: None if it is the id (LOWEST for none), as ids tell documents apart; else
    a table of doc, a number in the documents' order, and id."""
    id_ = F.col(key).cast("long")
    rows = df.select(F.coalesce(id_, F.lit(LOWEST)).alias("doc"), F.col(text).cast("binary").alias("text"))
    kinds = df.select(F.coalesce(id_, F.lit(LOWEST)).alias("doc"), id_.isNull().alias("none"), F.xxhash64(text).alias("h"))
    shared = kinds.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("none").alias("c"), F.max("none").alias("d"))
    if shared.where("a != b or c != d").isEmpty():
        return rows, None
    digest = F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))
    both = df.select(id_.alias("k"), digest.alias("d"), F.col(text).cast("binary").alias("text"))
    every = both.select("k", "d").distinct().repartitionByRange("k", "d").sortWithinPartitions("k", "d")
    # Partitions are ranges in order, and so are these numbers; written, so that they stay.
    numbers = shared_table(every.select(F.col("k").alias("id"), F.col("d").alias("digest"), F.monotonically_increasing_id().alias("doc")), "documents")
    met = both.join(numbers.hint("merge"), F.col("k").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")))
    return met.select("doc", "text"), numbers.select("doc", "id")


def dedup_substrings(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges s to e, exclusive), a row for each input row."""
    kind = df.schema[key].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer column")
    # The texts are dealt by document twice in the same way, so that Spark shuffles them once.
    rows, ids = _documents(df, key, text)
    ranges = removed_ranges(rows).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    both = rows.join(ranges.hint("merge"), "doc", "left").select("doc", "text", "ranges")
    out = both.mapInArrow(_remains, "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:long,e:long>>")
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
    if ids is None:
        return out.select(F.when(F.col("__id") != LOWEST, F.col("__id")).cast(kind).alias(key), *columns)
    return out.join(ids, F.col("__id") == F.col("doc")).select(F.col("id").cast(kind).alias(key), *columns)
