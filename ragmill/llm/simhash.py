"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints: 64-bit majority of the XXH64 values of word shingles. Each fingerprint maps to the bit counts of its 32 two-bit
segments, a point of a grid. Flipping a bit moves a point by one, so the Manhattan distance of two points is at most the
Hamming distance of their fingerprints: links are pairs within Manhattan distance `bits`, then verified exactly. Counts are
packed in thermometer code (0, 1, 2 as 00, 01, 11), so the Manhattan distance is the number of differing bits of the codes.

Range join: if the 32 coordinates are dealt to G groups, points within distance `bits` agree in whole in at least G - bits
groups. A grid cell is the coordinates of G - bits groups; each point is put in one cell for each choice of them, and what
shares a cell is compared, first by Manhattan, then by Hamming distance. G is chosen by cost from the number of fingerprints:
more groups are finer cells at the price of more of them. Every G finds every link.

Within a cell only a spanning forest of the links is emitted, never all pairs. A cell above CELL fingerprints is dealt to
pairs of blocks, an exact way with bounded tasks.

Links by similarity: near_duplicates(similarity=...) links texts by the Jaccard similarity of their shingle sets. 64 bits cannot find
these candidates: at a similarity of 0.8 a bit differs with a probability of 0.15, so two fingerprints lie 9.7 bits apart on average and
two pairs in a thousand more than 18, while 0.03 % of all unrelated pairs lie within 18 bits, a number that grows with the square of the
corpus. So fingerprints have 1024 bits there, in the same embedding and in more grids, and whole sets decide (near_copies).

Defined results: a null or empty text has fingerprint zero and links like any other; equal texts share a fingerprint and so a
component; texts are read whole, in parts of 65536 shingles; a null id is carried along and never names a component unless it is
alone in it (component null); repeated rows get a row each; a component's first row is the one of the least id, then of the
least text hash; an empty table gives no rows; only the id and the text are read, so other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, text_hash
from .components import connected_components

SHINGLE = 4
SEED = 42
BITS = 4
#: Cost of putting a fingerprint in one more cell, in comparisons.
CELL_COST = 50
#: Fingerprints of a cell that one task compares with each other.
CELL = 16_384
#: Cells up to this size are compared by shifting the sorted table, larger ones one by one.
SMALL = 24
_PAIRS = 0x5555555555555555


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 values of the word shingles of a UTF-8 text, in order and in parts; a shorter text is one shingle."""
    words = text.lower().split()  # for bytes both know ASCII alone
    if not words:
        return
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        yield np.array([digest(flat[a:b], SEED) for a, b in zip(starts[:n][part].tolist(), ends[part].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, shingle):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """__key, __hash (of the text) and fp (long, the fingerprint's bits), a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["__key", "__hash", "fp"])

    rows = df.select(F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.col(text).cast("binary").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, __hash long, fp long")


def groups_for(n: int, bits: int = BITS) -> int:
    """Groups of coordinates with the least cost for n fingerprints. Two unrelated ones agree in a coordinate with probability 3/8."""

    def cost(groups: int) -> float:
        return comb(groups, bits) * (CELL_COST + n * 0.375 ** (32 * (groups - bits) / groups))

    return min(range(bits + 1, 33), key=cost)


def grid_masks(groups: int, bits: int = BITS) -> list[int]:
    """For each choice of groups - bits groups of coordinates, the bits of the packed embedding that name a cell."""
    bounds = [round(i * 32 / groups) for i in range(groups + 1)]
    of = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(of[i] for i in chosen) for chosen in combinations(range(groups), groups - bits)]


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in thermometer code, two bits each."""
    low = fp.bitwiseAND(F.lit(_PAIRS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def embedded(fp: np.ndarray) -> np.ndarray:
    """The same of an array."""
    low, high = fp & np.uint64(_PAIRS), (fp >> np.uint64(1)) & np.uint64(_PAIRS)
    return low | high | ((low & high) << np.uint64(1))


def linked(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, bits: int) -> np.ndarray:
    """Where a and b are links: those within Manhattan distance of their embeddings, verified by Hamming distance."""
    near = np.flatnonzero(np.bitwise_count(ea ^ eb) <= bits)
    a, b = (x[near] if x.ndim else x for x in (a, b))
    return near[np.bitwise_count(a ^ b) <= bits]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of f that is linked, one less than the members of each component."""
    label, a, b, e = np.arange(len(f)), [], [], embedded(f)
    for i in range(len(f)):
        hit = linked(f, f[i], e, e[i], bits)
        found = np.unique(label[hit])
        if len(found) > 1:
            a += [i] * (len(found) - 1)
            first = {int(x): int(h) for h, x in zip(hit[::-1], label[hit][::-1], strict=True)}
            b += [first[int(x)] for x in found if x != label[i]]
            label[np.isin(label, found)] = found[0]
    return f[a], f[b]


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Reads fp sorted by cell; yields links (hot 0) and the members of cells above CELL (hot 1, in u, with their cell)."""
    names = ["hot", "u", "v", "combo", "cell"]

    def out(hot: int, u: np.ndarray, v: np.ndarray, combo: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), hot, np.int32)), *(pa.array(x.view(np.int64)) for x in (u, v)), pa.array(combo), pa.array(cell)], names=names)

    def compared(combo: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        new = np.flatnonzero(np.concatenate(([True], (combo[1:] != combo[:-1]) | (cell[1:] != cell[:-1]))))
        count = np.diff(np.append(new, len(fp)))
        group, sized = np.repeat(np.arange(len(new)), count), np.repeat(count, count)
        zero = lambda x: (np.zeros(len(x), np.int32), np.zeros(len(x), np.int64))
        few = np.flatnonzero((sized > 1) & (sized <= SMALL))
        f, g = fp[few], group[few]
        e = embedded(f)
        for d in range(1, min(SMALL, len(f))):
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            near = same[linked(f[same], f[same + d], e[same], e[same + d], bits)]
            if len(near):
                yield out(0, f[near], f[near + d], *zero(near))
        for k in np.flatnonzero(count > SMALL):
            part = slice(new[k], new[k] + count[k])
            if count[k] > CELL:
                yield out(1, fp[part], fp[part], combo[part], cell[part])
            else:
                u, v = _forest(fp[part], bits)
                if len(u):
                    yield out(0, u, v, *zero(u))

    held, hot = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)], None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now[2] = now[2].view(np.uint64)
        combo, cell, fp = held = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if hot and len(fp):  # more of a cell whose first rows have already gone to the blocks
            mine = (combo == hot[0]) & (cell == hot[1])
            yield out(1, fp[mine], fp[mine], combo[mine], cell[mine])
            combo, cell, fp = held = [x[~mine] for x in held]
        if not len(fp):
            continue
        other = np.flatnonzero((combo != combo[-1]) | (cell != cell[-1]))
        cut = other[-1] + 1 if len(other) else 0
        yield from compared(*(x[:cut] for x in held))
        combo, cell, fp = held = [x[cut:] for x in held]
        hot = None
        if len(fp) > CELL:
            hot = (combo[0], cell[0])
            yield out(1, fp, fp, combo, cell)
            held = [x[:0] for x in held]
    yield from compared(*held)


def _block_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Reads the fingerprints of whole block pairs, sorted by pair; yields their links as forests."""
    held: dict[tuple, list[np.ndarray]] = {}

    def done(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _forest(np.unique(np.concatenate(parts)), bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        for pair, rows in batch.to_pandas().groupby(["combo", "cell", "pair"], sort=False):
            for other in [k for k in held if k != pair]:
                yield done(held.pop(other))
            held.setdefault(pair, []).append(rows["u"].to_numpy().view(np.uint64))
    for parts in held.values():
        yield done(parts)


def links(fps: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """u, v: links between distinct fingerprints (fps: fp), at least a spanning forest of all within so many bits."""
    masks = F.array(*[F.lit(_signed(m)) for m in grid_masks(groups_for(n, bits), bits)])
    cells = fps.select("fp", F.posexplode(F.transform(masks, lambda m: embed(F.col("fp")).bitwiseAND(m))).alias("combo", "cell"))
    found = cells.select("combo", "cell", "fp").repartition("combo", "cell").sortWithinPartitions("combo", "cell")
    found = shared_table(found.mapInArrow(lambda x: _links(x, bits), "hot int, u long, v long, combo int, cell long"), "links")
    hot = found.where("hot = 1")
    blocks = hot.groupBy("combo", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL // 2)).cast("int").alias("__b"))
    dealt = hot.join(blocks, ["combo", "cell"]).withColumn("__i", F.pmod(F.xxhash64("u"), F.col("__b")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__b") - 1), lambda j: F.least("__i", j) * F.col("__b") + F.greatest("__i", j))
    dealt = dealt.select("combo", "cell", F.explode(pairs).alias("pair"), "u").repartition("combo", "cell", "pair").sortWithinPartitions("combo", "cell", "pair")
    return found.where("hot = 0").select("u", "v").unionByName(dealt.mapInArrow(lambda x: _block_links(x, bits), "u long, v long"))


def _first_row(key: Column, text_hash: Column) -> Column:
    """What the first row of a component is the least of: rows without an id come last."""
    return F.struct(key.isNull().alias("none"), key.alias("key"), text_hash.alias("hash"))


def with_components(marked: DataFrame, node: str, roots: DataFrame, *, key: str) -> DataFrame:
    """key, text_hash, node, component (an id) and first (whether the row is its component's first one) from rows of __key, __hash and a
    node, and the roots of nodes."""
    distinct = marked.groupBy(node).agg(F.min(_first_row(F.col("__key"), F.col("__hash"))).alias("__least"))
    rooted = shared_table(distinct.join(roots.hint("merge"), F.col(node) == F.col("u"), "left").select(node, F.coalesce("root", node).alias("root"), "__least"), "rooted")
    least = shared_table(rooted.groupBy("root").agg(F.min("__least").alias("__first")), "least")
    named = shared_table(rooted.join(least.hint("merge"), "root").select(node, "__first"), "named")
    out = marked.join(named.hint("merge"), node)
    first = F.col("__first.key").eqNullSafe(F.col("__key")) & (F.col("__first.hash") == F.col("__hash"))
    return out.select(F.col("__key").alias(key), F.col("__hash").alias("text_hash"), node, F.col("__first.key").alias("component"), first.alias("first"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, similarity: tuple[int, int] | None = None) -> DataFrame:
    """key, text_hash, fp (or node), component and first, a row for each input row. Component: the least key among all that links
    reach; first: whether the row is the one of its component that stays. Links: fingerprints within so many bits, or, if a
    similarity is given as a fraction (numerator, denominator), sets of shingles of so much similarity at least."""
    if similarity:
        from .near_copies import similar_texts

        return similar_texts(df, key=key, text=text, shingle=shingle, share=similarity)
    marked = shared_table(fingerprints(df, key=key, text=text, shingle=shingle), "fingerprints")
    distinct = shared_table(marked.select("fp").distinct(), "distinct")
    return with_components(marked, "fp", connected_components(links(distinct, distinct.count(), bits)), key=key)
