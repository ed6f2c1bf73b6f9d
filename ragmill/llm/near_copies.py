"""The near-duplicates of simhash.near_duplicates by the Jaccard similarity of word shingles: SimHash fingerprints of 1024 bits name
candidates by op7's embedding and grid cells, the shingle sets decide.

A text is the set of the XXH64 values of its shingles; texts with equal sets are one node. A node's fingerprint is the majority of the
1024 bits that each shingle's hash is drawn out to. As in op7 two-bit segments are embedded as their bit counts, 512 coordinates, and
points meet in grid cells. In 64 bits two texts of similarity 0.8 lie too far apart for cells that find every pair within a radius, so
a grid's cell is the coordinates of a few segments, and there are so many grids that such a pair (its bits differ with a probability of
0.151, its coordinates agree with one of 0.73) shares MEETINGS cells on average. What shares a cell is compared by Manhattan, then by
Hamming distance in one word of the fingerprint, a different one from grid to grid. By calculation a pair at 0.8 is missed once or twice in a million with 8 coordinates,
six times with 10, and one at 0.85 three times in 10^9; four shingles of a text's five, whose bits differ most (0.19), once in a thousand.
Grids are met in rounds, since the cells of all of them are several times the corpus: a round's shuffle is gone before the next begins.

Coordinates of a cell: as many as keep cells of unrelated texts below MEMBERS on average (8 up to 2 million nodes, 10 at 10 million), and
the grids follow (232 for 8, 434 for 10). Nothing is linked on its fingerprint: candidates that reach each other are a cluster, a node is in
one at most, and sets of a cluster are compared in whole, but for pairs whose 1024 bits lie FAR apart or more.

Of the members of a cell or cluster only a spanning forest of the links is emitted, never all pairs. A cell above CELL nodes and a
cluster whose sets hold more than BLOCK shingles are dealt to pairs of blocks, all of which are compared.

Defined results: a text of fewer words than a shingle is one shingle; texts without words, null ones too, are one node; a null id is
carried along and never names a component unless it is alone in it (component null); texts are read whole; repeated rows get a row
each; a component's first row is the one of the least id, then of the least text hash; an empty table gives no rows; only the id and
the text are read, so other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, text_hash
from .components import connected_components
from .simhash import embedded, linked, shingle_hashes, with_components

SHINGLE = 5
#: Least similarity of a link, as a fraction: 4 of 5.
SHARE = (4, 5)
#: 64-bit words of a fingerprint, and how many bits of one may differ in a cell.
WORDS, NEAR = 16, 14
#: Least coordinates of a cell, unrelated nodes of a cell on average, cells that a pair of the least similarity shares on average.
COORDINATES, MEMBERS, MEETINGS = 8, 800, 18
#: Grids of the first round, and of any other: what a round shuffles is bounded by the nodes and is gone before the next begins.
FIRST, ROUND = 24, 42
#: Nodes of a cell that one task compares with each other.
CELL = 16_384
#: Cells up to this size are compared by shifting the sorted table, larger ones one by one.
SMALL = 96
#: Sets of SIZED shingles or more whose fingerprints differ in so many bits are not compared.
FAR, SIZED = 240, 16
#: Shingles of a block of sets.
BLOCK = 4 << 20
_RNG = np.random.default_rng(42)
_SALT, _ODD = _RNG.integers(1 << 63, size=WORDS, dtype=np.uint64), _RNG.integers(1 << 62, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The majority of the bits that the hashes are drawn out to, in WORDS words; zero for the empty set."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 240):  # sums of 240 bits fit a byte
        x = (h[at : at + 240, None] ^ _SALT) * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def grids_for(n: int, share: tuple[int, int] = SHARE) -> np.ndarray:
    """For n nodes, the coordinates of each grid's cells, a row for each grid. Sets of a similarity s have a cosine of 2 s / (1 + s) at
    least; two unrelated nodes agree in a coordinate with probability 3/8."""
    apart = acos(2 * share[0] / (share[0] + share[1])) / pi
    k = COORDINATES
    while n * 0.375**k > MEMBERS:
        k += 1
    near = sum(comb(64, i) * apart**i * (1 - apart) ** (64 - i) for i in range(NEAR + 1))
    grids = ceil(MEETINGS / (near * ((1 - apart) ** 2 + apart**2 / 2) ** k))
    rng, each = np.random.default_rng(7), 32 * WORDS // k
    return np.concatenate([rng.permutation(32 * WORDS)[: each * k].reshape(each, k) for _ in range(ceil(grids / each))])[:grids]


def _nodes(shingle: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(2)]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            fps = pa.array([wide_fingerprint(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(h) for h in sets], pa.int64()), fps], names=["__key", "__hash", "node", "n", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(x.as_py() or b"", shingle).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "set"])

    return run


def _cells(grids: np.ndarray, first: int = 0):
    """Reads node and fp; yields node, cell (of a grid) and word, the one of the fingerprint that the grid compares. first: the number of
    the first grid."""
    number = first + np.arange(len(grids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 400_000 // len(grids))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                fp = np.stack([np.frombuffer(x.as_py(), np.uint64) for x in part.column(1)])
                code = embedded(fp).view(np.uint8)
                counts = np.stack([code >> i & 1 for i in range(8)], 2).reshape(len(fp), -1, 2).sum(2, dtype=np.int64)
                cell = np.zeros((len(grids), len(fp)), np.int64)
                for c in grids.T:
                    cell = cell * 3 + counts.T[c]
                cell += (number * 3 ** grids.shape[1])[:, None]
                word = fp.T[number % WORDS]
                node = np.tile(part.column(0).to_numpy(), len(grids))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(cell.ravel()), pa.array(word.ravel().view(np.int64))], names=["node", "cell", "word"])

    return run


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, the least place of each component, after the links i, j."""
    while (label[i] != label[j]).any():
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _met(cell: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, sorted by cell, and the least places of their components, for those that have a lesser one."""
    new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    count = np.diff(np.append(new, len(cell)))
    label, e = np.arange(len(cell)), embedded(word)
    same, d = np.flatnonzero(np.repeat(count, count) <= SMALL), 1
    ends = np.repeat(new + count, count)
    while len(same := same[same + d < ends[same]]):
        near = same[linked(word[same], word[same + d], e[same], e[same + d], NEAR)]
        label = _joined(label, near, near + d)
        d += 1
    for k in np.flatnonzero(count > SMALL):
        part = slice(new[k], new[k] + count[k])
        label[part] = new[k] + _forest(word[part], e[part])
    return (u := np.flatnonzero(label != np.arange(len(cell)))), label[u]


def _forest(word: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The labels of one cell's members."""
    label, step = np.arange(len(word)), max(1, (1 << 20) // len(word))
    for at in range(0, len(word), step):
        i, j = np.nonzero(np.bitwise_count(e[at : at + step, None] ^ e[None, at:]) <= NEAR)
        i, j = (i + at)[i < j], (j + at)[i < j]
        close = np.bitwise_count(word[i] ^ word[j]) <= NEAR
        label = _joined(label, i[close], j[close])
    return label


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads node, cell and word, sorted by cell and node; yields links u, v (hot 0), and the members of cells above CELL: word in u, node in
    v and their cell (hot 1)."""

    def out(hot: int, u: np.ndarray, v: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), hot, np.int32)), *(pa.array(x.view(np.int64)) for x in (u, v, cell))], names=["hot", "u", "v", "cell"])

    def compared(node: np.ndarray, cell: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        u, v = _met(cell, word.view(np.uint64))
        found = np.unique(np.stack((node[u], node[v]), 1)[node[u] != node[v]], axis=0)
        return out(0, found[:, 0], found[:, 1], np.zeros(len(found), np.int64))

    held, hot = [np.zeros(0, np.int64)] * 3, None
    for batch in batches:
        node, cell, word = held = [np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(held)]
        if hot is not None:  # more of a cell whose first rows have already gone to the blocks
            cut = int(np.searchsorted(cell, hot, "right"))
            yield out(1, word[:cut], node[:cut], cell[:cut])
            node, cell, word = held = [x[cut:] for x in held]
        if not len(cell):
            continue
        hot, cut = None, int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield compared(*(x[:cut] for x in held))
            node, cell, word = held = [x[cut:] for x in held]
        if len(cell) > CELL:
            hot = cell[0]
            yield out(1, word, node, cell)
            held = [x[:0] for x in held]
    if len(held[0]):
        yield compared(*held)


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads at (a cell and a pair of its blocks), node and word, sorted by at and node; yields the links of each as a forest."""

    def done(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        node, word = map(np.concatenate, zip(*parts, strict=True))
        label = _forest(word.view(np.uint64), embedded(word.view(np.uint64)))
        u = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[label[u]])], names=["u", "v"])

    at, parts = None, []
    for batch in batches:
        cell, pair, node, word = (batch.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1]))))
        for a, b in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            if parts and at != (cell[a], pair[a]):
                yield done(parts)
                parts = []
            at = (cell[a], pair[a])
            parts.append((node[a:b], word[a:b]))
    if parts:
        yield done(parts)


def _dealt(blocks: Column, *row: Column) -> Column:
    """The pairs of blocks that a row is dealt to."""
    i = F.pmod(F.xxhash64(*row), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(i, j) * blocks + F.greatest(i, j))


def _in_cells(nodes: DataFrame, grids: np.ndarray) -> DataFrame:
    """u, v: links between nodes (node, fp; rows may share a node) that are near each other in a cell, a spanning forest for each cell.
    nodes is read once for each ROUND grids: cells are many times the size of the fingerprints, so not all grids are shuffled at once."""
    rounds = []
    for at in range(0, len(grids), ROUND):
        cells = nodes.mapInArrow(_cells(grids[at : at + ROUND], at), "node long, cell long, word long").repartition("cell").sortWithinPartitions("cell", "node")
        rounds.append(shared_table(cells.mapInArrow(_candidates, "hot int, u long, v long, cell long"), "candidates"))
    found = reduce(DataFrame.unionByName, rounds)
    hot = found.where("hot = 1").select("cell", "u", "v").distinct()
    blocks = hot.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, CELL // 2))).cast("int").alias("__b"))
    dealt = hot.join(blocks, "cell").select("cell", F.explode(_dealt(F.col("__b"), F.col("u"), F.col("v"))).alias("pair"), "v", "u")
    dealt = dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "v")
    return found.where("hot = 0").select("u", "v").unionByName(dealt.mapInArrow(_block_candidates, "u long, v long"))


def candidates(nodes: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """u, v: links that join all nodes (node, fp) that are joined by being near each other in cells. The first grids find most of them; in the
    others a node goes by the name of its component, so what is joined already makes no more links."""
    grids, nodes = grids_for(nodes.count(), share), nodes.select("node", "fp")
    roots = connected_components(_in_cells(nodes, grids[:FIRST]))
    named = nodes.join(roots.withColumnRenamed("u", "node").hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("node"), "fp")
    named = shared_table(named, "named")
    return _in_cells(named, grids[FIRST:]).unionByName(roots.select("u", F.col("root").alias("v")))


def forest(sets: list[np.ndarray], fps: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[list[int], list[int]]:
    """Links that join all sets that are linked, one less than the members of each component. fps: a row of words for each set."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts, label, a, b = ends - size, np.arange(len(sets)), [], []
    here = np.zeros(ids.max() + 1, bool)
    for i in range(len(sets)):
        other = np.flatnonzero((label != label[i]) & (np.minimum(size, size[i]) * share[1] >= np.maximum(size, size[i]) * share[0]))
        if size[i] >= SIZED:
            other = other[(size[other] < SIZED) | (np.bitwise_count(fps[other] ^ fps[i]).sum(1, dtype=np.int64) < FAR)]
        if not len(other):
            continue
        own = ids[starts[i] : ends[i]]
        here[own] = True
        among = np.concatenate([ids[starts[j] : ends[j]] for j in other.tolist()])
        shared = np.add.reduceat(here[among], np.cumsum(size[other]) - size[other], dtype=np.int64)
        here[own] = False
        hit = other[shared * sum(share) >= share[0] * (size[other] + size[i])]
        found, first = np.unique(label[hit], return_index=True)
        a += [i] * len(found)
        b += hit[first].tolist()
        label[np.isin(label, found)] = label[i]
    return a, b


def _links(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Reads group, pair (of blocks), node, fp and set, sorted by group and pair; yields links u, v."""

    def done(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.array(list(held), np.int64)
        fps, sets = zip(*held.values(), strict=True)
        a, b = forest(list(sets), np.stack(fps), share) if len(nodes) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["u", "v"])

    at, held = None, {}
    for batch in batches:
        for group, pair, node, fp, one in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            if (group, pair) != at:
                if held:
                    yield done(held)
                at, held = (group, pair), {}
            held[node] = (np.frombuffer(fp, np.uint64), np.frombuffer(one.as_py(), np.uint64))
    if held:
        yield done(held)


def links(docs: DataFrame, marked: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """u, v: links between nodes, at least a spanning forest of all that are in a cluster of candidates and similar enough."""
    nodes = shared_table(marked.where("n > 0").groupBy("node").agg(F.min(F.struct("__key", "__hash")).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    roots = connected_components(candidates(nodes, share))
    clusters = roots.select(F.col("u").alias("node"), F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    members = shared_table(nodes.join(clusters.hint("merge"), "node"), "members")
    blocks = shared_table(members.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("__b")), "blocks")
    picked = shared_table(members.select("node", "least.__key", F.col("least.__hash").alias("__h")), "picked")
    texts = docs.join(picked, docs["__key"].eqNullSafe(picked["__key"]) & (docs["__hash"] == F.col("__h"))).select("node", "__text")
    texts = shared_table(texts, "texts")  # all texts have been shuffled for it; those files go before the sets are
    sets = texts.mapInArrow(_sets(shingle), "node long, set binary").dropDuplicates(["node"])
    dealt = members.join(blocks.hint("merge"), "cluster").select("cluster", F.explode(_dealt(F.col("__b"), F.col("node"))).alias("pair"), "node", "fp")
    dealt = dealt.join(sets.hint("merge"), "node").select("cluster", "pair", "node", "fp", "set")
    return dealt.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair").mapInArrow(lambda x: _links(x, share), "u long, v long")


def similar_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """key, text_hash, node, component and first, as simhash.near_duplicates gives them, a row for each input row."""
    docs = df.select(F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.col(text).cast("binary").alias("__text"))
    kind = docs.schema["__key"].dataType.simpleString()
    marked = shared_table(docs.mapInArrow(_nodes(shingle), f"__key {kind}, __hash long, node long, n long, fp binary"), "marked")
    roots = connected_components(links(docs, marked, shingle, share))
    return with_components(marked.select("__key", "__hash", "node"), "node", roots, key=key)


#: The name that the brute-force tests know.
near_duplicates = similar_texts
