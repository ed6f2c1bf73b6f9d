"""Best-fit packing of token pieces by linear grouping.

Texts become token ids, an end id after each. Texts beyond the capacity are cut so that only the first piece is short. How
many pieces there are of each length is all the planner needs: at most `capacity` numbers, whatever the input's size. It
works on the driver in four steps. (1) Large lengths go to a few groups of equal cardinality and count as their group's
largest. (2) The least number of sequences for these few sizes is a linear program over configurations (how many pieces of each
size share a sequence), solved by column generation; its whole parts are taken. (3) Actual lengths take the places of the
rounded ones, but for the smallest place of each configuration: so what rounding has cost is still open. (4) The pieces of these
places, those that the whole parts have left over, and the small ones fill the gaps best-fit, largest first. Steps 1 to 4 are
planned for several bounds of what is large and for several shares of the whole parts, and plain best-fit from the same counts as a floor; the plan with the fewest
sequences is taken, one by groups if they tie. It says which ranks of each length go where; pieces get their rank in their length
by a distributed numbering and look their place up.

Ids are those of the `tokenizers` file. Words are encoded once per worker and kept (the pre-tokenizer never joins a word to
what follows a space); a text holding the special token's string is encoded by `tokenizers` itself.

Defined results: a null text is an empty one and gives its end id alone; texts of any length are encoded whole; a null id has
pieces like any other; repeated rows get places of their own; pieces of one length are interchangeable, and those that tie in id,
piece and checksum are equal; an empty table gives no rows; only the id and the text are read, so other columns have no effect.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

CAPACITY = 2048
END_ID = 0
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 48
#: Lengths above the capacity divided by these are large, one plan for each.
LARGE = (8, 4, 3, 2)
#: Shares of the configurations' numbers that are taken, a plan for each: what is left gives best-fit more pieces to close gaps with.
TAKEN = (1.0, 0.5, 0.25)
#: Rows of a linear program's simplex that bring no gain before it stops, and rows in all: any of them is a feasible plan.
STALLED, STEPS = 200, 4000
#: Pieces of one length that a task numbers together, while there are fewer than PARTS * PIECES; (length, part) pairs.
PIECES, PARTS = 4096, 1 << 17
#: A column that deals rows which are alike to SALTS parts.
SALT, SALTS = "__salt", 1024
#: Words that a worker keeps with their ids.
KEPT_WORDS = 400_000
SPECIAL = "<|endoftext|>"
#: A space beside other white space or at an end.
_RUNS = re.compile(r" \s|\s |^ | \Z")

# Tokens


class _Words(dict):
    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return got


_encoders: dict[tuple[str, str], Callable[[str], bytes]] = {}


def encoder(json_path: str, ranks_path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, four little-endian bytes each. Made once per worker."""
    if (json_path, ranks_path) not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words, whole = _Words(plain.encode_ordinary), Tokenizer.from_file(json_path)

        def encode(text: str) -> bytes:
            if SPECIAL in text:
                return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if _RUNS.search(text):  # no safe cut at single spaces
                return np.array(plain.encode_ordinary(text), "<u4").tobytes()
            first, *rest = text.split(" ")
            return (words[first] if first else b"") + b"".join([words[" " + p] for p in rest])

        _encoders[json_path, ranks_path] = encode
    return _encoders[json_path, ranks_path]


def _pieces(json_path: str, ranks_path: str, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                data = encode(x.as_py() or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = data[4 * a : 4 * b]
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["__key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """__key, piece, start, length, ids_crc32 and, if asked for, ids: the pieces of each text. tokenizer: name of the files."""
    import public_tokenizers

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    run = _pieces(public_tokenizers.path(f"{tokenizer}.json"), public_tokenizers.path(f"{tokenizer}.tiktoken"), capacity, with_ids)
    return rows.mapInArrow(run, f"__key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# Plan


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks low to high (exclusive): each of the sequences from first on takes `each` of them from offset on."""

    length: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes in a capacity: its value and how many of each size. A knapsack by number of pieces."""
    most = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1, np.int32)
        for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if v > 0:
                with_i = best[: capacity + 1 - s] + v
                better = with_i > new[s:] + 1e-12
                new[s:][better] = with_i[better]
                pick[s:][better] = i
        if (pick < 0).all():
            break
        best = new
        picks.append(pick)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (i := int(pick[room])) >= 0:
            counts[i] += 1
            room -= int(sizes[i])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and how often the linear program takes each: least in sum, with as many places as pieces of each size.

    A revised simplex: the start takes each size alone; a knapsack under the dual prices finds the column to enter.
    """
    m, size = len(sizes), np.array(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse, level = np.diag(1 / np.diag(columns)), np.array(demand, float) / np.diag(columns)
    total, stalled = level.sum(), 0
    for _ in range(STEPS):
        value, counts = best_configuration(size, inverse.sum(0), capacity)
        if value <= 1 + 1e-9 or stalled > STALLED:
            break
        step = inverse @ counts
        ratios = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        by = ratios[out]
        level -= by * step
        level[out] = by
        level = np.maximum(level, 0)
        columns[:, out] = counts
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        stalled = 0 if level.sum() < total - 1e-7 else stalled + 1
        total = level.sum()
    return [(columns[:, j].astype(int).tolist(), float(level[j])) for j in range(m)]


class Planner:
    """Runs so far, the ranks that are dealt out of each length, and the gaps: room left -> (first sequence, how many)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.used = capacity, [], 0
        self.rank: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def place(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.rank[length], self.rank[length] + n * each, first, each, offset))
        self.rank[length] += n * each

    def gap(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.gaps:
                self.gaps[room] = []
                bisect.insort(self.rooms, room)
            self.gaps[room].append((first, n))

    def sequences(self, slots: list[list[tuple[int, int]]], times: int) -> None:
        """So many sequences; each slot says which lengths take its place, one after the other."""
        ends = sorted({int(e) for got in slots for e in np.cumsum([n for _, n in got])} | {times})
        low, at = 0, [[0, 0] for _ in slots]
        for high in ends:
            n, offset = high - low, 0
            for got, pos in zip(slots, at, strict=True):
                if pos[0] == len(got):  # no pieces left for this place
                    continue
                s, count = got[pos[0]]
                self.place(s, n, self.used + low, 1, offset)
                offset += s
                pos[1] += n
                if pos[1] == count:
                    pos[:] = [pos[0] + 1, 0]
            self.gap(self.capacity - offset, self.used + low, n)
            low = high
        self.used += times

    def best_fit(self, counts: dict[int, int]) -> None:
        """All pieces, largest first, each into the least room that holds it."""
        for s in sorted(counts, reverse=True):
            n = counts[s]
            while n:
                i = bisect.bisect_left(self.rooms, s)
                if i == len(self.rooms):
                    new = -(-n // (self.capacity // s))
                    self.gap(self.capacity, self.used, new)
                    self.used += new
                    continue
                room = self.rooms[i]
                first, count = self.gaps[room].pop()
                if not self.gaps[room]:
                    del self.gaps[room], self.rooms[i]
                each = min(room // s, n)
                take = min(count, n // each)
                self.place(s, take, first, each, self.capacity - room)
                n -= take * each
                self.gap(room - each * s, first, take)
                self.gap(room, first + take, count - take)


def grouped(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """(length, how many), largest first, as groups of equal cardinality, cut anywhere: each group's largest length and its members.
    Lengths that are no more than the groups are sizes as they are."""
    if len(large) <= groups:
        return [s for s, _ in large], [[[s, n]] for s, n in large]
    total, members, sizes = sum(n for _, n in large), [], []
    bounds = [total * (g + 1) // groups for g in range(groups)]
    seen = g = 0
    for s, n in large:
        while n:
            while bounds[g] <= seen:
                g += 1
            take = min(n, bounds[g] - seen)
            if members and members[-1][0] == g:
                members[-1][1].append([s, take])
            else:
                members.append((g, [[s, take]]))
                sizes.append(s)
            seen += take
            n -= take
    return sizes, [m for _, m in members]


@lru_cache(maxsize=len(LARGE))
def _solved(sizes: tuple[int, ...], demand: tuple[int, ...], capacity: int) -> list[tuple[list[int], float]]:
    return configurations(list(sizes), list(demand), capacity)


def grouping_plan(histogram: dict[int, int], capacity: int, groups: int, small: int, taken: float = 1.0) -> Planner:
    """Places by linear grouping: steps 1 to 4. Lengths up to small are left to step 4, and so is what configurations would hold beyond the
    share of their number that is taken."""
    out = Planner(capacity)
    sizes, supply = grouped([(s, histogram[s]) for s in sorted(histogram, reverse=True) if s > small], groups)
    # Groups of one size are one size of the program.
    for i in range(len(sizes) - 1, 0, -1):
        if sizes[i] == sizes[i - 1]:
            supply[i - 1] += supply.pop(i)
            sizes.pop(i)
    left = [sum(n for _, n in m) for m in supply]
    chosen = _solved(tuple(sizes), tuple(left), capacity) if sizes else []
    for counts, times in sorted(chosen, key=lambda x: -x[1]):
        # Whole parts; of a size that runs out the configuration is closed.
        times = min([int(times * taken + 1e-6), *(left[i] // k for i, k in enumerate(counts) if k)])
        if times:
            slots, last = [], max(i for i, k in enumerate(counts) if k) if sum(counts) > 1 else -1
            for i, k in enumerate(counts):
                left[i] -= k * times
                slots += [_taken(supply[i], times) for _ in range(k - (i == last))]
            out.sequences(slots, times)
    rest: dict[int, int] = defaultdict(int, {s: n for s, n in histogram.items() if s <= small})
    for own in supply:
        for s, n in own:
            rest[s] += n
    out.best_fit(rest)
    return out


def _taken(supply: list[list[int]], n: int) -> list[tuple[int, int]]:
    """n actual lengths out of a group, largest first."""
    got = []
    while n:
        s, have = supply[0]
        take = min(have, n)
        got.append((s, take))
        n -= take
        supply[0][1] -= take
        if not supply[0][1]:
            supply.pop(0)
    return got


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Places for all pieces, given how many there are of each length."""
    plain = Planner(capacity)
    plain.best_fit(histogram)
    plans = [grouping_plan(histogram, capacity, groups, capacity // d, taken) for taken in TAKEN for d in LARGE]
    return min([*plans, plain], key=lambda p: p.used).runs


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces with __key, piece, length and ids_crc32. The table is read three times: pass a written one. A
    column SALT parts rows that are alike in all these."""
    spark = pieces.sparkSession
    # At most `capacity` rows: a count for each length. Parts in proportion to them: at most PARTS + capacity, whatever the input's size.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(PIECES, sum(histogram.values()) // PARTS)
    parts = spark.createDataFrame(pa.table({"__length": pa.array(list(histogram), pa.int64()), "__parts": pa.array([-(-n // share) for n in histogram.values()], pa.int64())}))
    part = F.pmod(F.xxhash64("__key", "piece", "ids_crc32", *([SALT] if SALT in pieces.columns else [])), F.col("__parts"))
    dealt = pieces.join(F.broadcast(parts), pieces["length"] == parts["__length"]).withColumn("__part", part).drop("__length", "__parts")
    counts = dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    runs = plan(histogram, capacity, groups)
    columns = {k: pa.array([getattr(r, k) for r in runs], pa.int64()) for k in ("length", "low", "high", "first", "each", "offset")}
    table = spark.createDataFrame(pa.table(columns))
    within = Window.partitionBy("length", "__part").orderBy("__key", "piece", "ids_crc32")
    numbered = dealt.withColumn("__at", F.row_number().over(within))
    # Both broadcasts are bounded: PARTS + capacity offsets, and a plan made from `capacity` counts.
    ranked = numbered.join(F.broadcast(offsets), ["length", "__part"]).withColumn("__rank", F.col("__before") + F.col("__at") - 1)
    fits = (ranked["length"] == table["length"]) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high"))
    step = F.col("__rank") - F.col("low")
    placed = ranked.join(F.broadcast(table), fits).withColumn("sequence_id", F.col("first") + F.floor(step / F.col("each")).cast("long"))
    placed = placed.withColumn("__offset", F.col("offset") + F.pmod(step, F.col("each")) * ranked["length"])
    return placed.select(*[ranked[c] for c in pieces.columns if c != SALT], "sequence_id", F.col("__offset").alias("offset"))


def pack_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    pieces = token_pieces(df, key=key, text=text, tokenizer=tokenizer, capacity=capacity)
    pieces = shared_table(pieces.withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "pieces")
    return pack(pieces, capacity=capacity, groups=groups).withColumnRenamed("__key", key)
