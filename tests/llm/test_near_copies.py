"""The pipeline's near-copy stage: five-word shingles, Jaccard similarity of 0.8 or more, against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragmill.llm import near_copies


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_against_all_pairs(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(5)
    own = []
    for c in range(8):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for k in range(12):  # k changed words, up to five shingles each: similarities from 1 to well below 0.8
            ws = list(base)
            for at in rng.choice(200, k // 2 * (c % 3 + 1), replace=False):
                ws[at] = f"x{rng.integers(0, 10**6)}"
            own.append((10_000 + 100 * c + k, " ".join(ws)))
    own += [(20_000, None), (20_001, " \n"), (20_002, "one two"), (20_003, "ONE  two"), (20_004, "one two three")]
    docs = spark.createDataFrame(own, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(i != c for i, c in want.items()) > 40
    assert {r["doc_id"]: r["component"] for r in near_copies.near_duplicates(docs).collect()} == want
    assert near_copies.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_similar_texts(spark, sf_dir):
    """Two changed words of 100 leave a similarity of about 0.81, far more than 4 bits apart; three more leave less than 0.8."""
    base = [f"word{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[20] = near[70] = "other"
    for at in (10, 25, 40, 55, 70):
        far[at] = "changed"
    rows = [(i, " ".join(t)) for i, t in enumerate((base, near, far))] + [(2, " ".join(far)), (None, " ".join(near) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]


def near_families(seed, families=6, each=30):
    """Sets of 160 hashes; in a family each differs from its base in 0 to 25 of them."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(families):
        base = rng.integers(1 << 63, size=160, dtype=np.uint64)
        for k in range(each):
            own = base.copy()
            own[: k * 25 // each] = rng.integers(1 << 63, size=k * 25 // each, dtype=np.uint64)
            out.append(np.unique(own))
    return out


@pytest.mark.parametrize("cell", [16_384, 12])
def test_fingerprints_name_all_similar_pairs(spark, cell, monkeypatch):
    """Candidates come from 1024-bit SimHash fingerprints in grid cells; cells above CELL are dealt to blocks."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "SMALL", 5)
    sets = near_families(3)
    fps = [near_copies.wide_fingerprint(s) for s in sets]
    assert np.bitwise_count(fps[0] ^ fps[29]).sum() > 64 and np.bitwise_count(fps[0] ^ fps[30]).sum() > 400
    nodes = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(fps)], "node long, fp binary")
    found = near_copies.candidates(nodes).distinct().collect()
    root = list(range(len(sets)))
    for u, v in ((r["u"], r["v"]) for r in found):
        a, b = root[u], root[v]
        root = [b if x == a else x for x in root]
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            assert root[i] == root[j] or 9 * shared < 4 * (len(a) + len(sets[j]))
    assert len(set(root)) == 6


def test_cells_are_counts_of_two_bit_segments():
    """Grids follow the number of nodes, so that cells of unrelated texts stay small; coordinates are those of op7's embedding."""
    assert [near_copies.grids_for(n).shape[1] for n in (100, 2 * 10**6, 10**7)] == [8, 8, 10]
    grids = near_copies.grids_for(100)
    fps = [near_copies.wide_fingerprint(s) for s in near_families(4, 1, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([f.tobytes() for f in fps])], names=["node", "fp"])
    got = {(r["node"], r["cell"] // 3**8): (r["cell"] % 3**8, r["word"]) for b in near_copies._cells(grids)([batch]) for r in b.to_pylist()}
    for i, f in enumerate(fps):
        bits = np.unpackbits(f.view(np.uint8), bitorder="little").reshape(-1, 2).sum(1)
        for g, row in enumerate(grids):
            assert got[i, g] == (int("".join(map(str, bits[row])), 3), int(f.view(np.int64)[g % 16]))
