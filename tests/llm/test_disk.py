"""What is on disk at once: a written table leaves no shuffle files, and grids are shuffled in rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ragmill.llm import common, near_copies


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle")}


def test_a_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name, None)
    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    assert common.shared_table(rows, "counts").agg(F.sum("count")).first()[0] == 1000
    left = {n.split("_")[1] for n in shuffle_files(spark) - before}
    assert len(left) <= 1  # that of the sum, which is no table
    assert spark.conf.get(name, None) == setting


def test_grids_are_shuffled_in_rounds(spark, monkeypatch):
    seen, cells = [], near_copies._cells
    monkeypatch.setattr(near_copies, "_cells", lambda grids, *first: seen.append((len(grids), *first)) or cells(grids, *first))
    rng = np.random.default_rng(1)
    fps = [near_copies.wide_fingerprint(rng.integers(1 << 63, size=50, dtype=np.uint64)) for _ in range(40)]
    nodes = spark.createDataFrame([(i, bytearray(fps[i // 2].tobytes())) for i in range(80)], "node long, fp binary")
    found = near_copies.candidates(nodes)
    assert {tuple(sorted(r)) for r in found.distinct().collect()} == {(2 * i, 2 * i + 1) for i in range(40)}
    assert max(n for n, *_ in seen) <= 42 and sum(n for n, *_ in seen) == len(near_copies.grids_for(80))
    assert [first for _, first in seen] == [0, 0, 42, 84, 126, 168]


def test_cells_of_rounds_are_those_of_all_grids_at_once():
    import pyarrow as pa

    grids = near_copies.grids_for(100)[:60]
    rng = np.random.default_rng(2)
    fps = [near_copies.wide_fingerprint(rng.integers(1 << 63, size=50, dtype=np.uint64)).tobytes() for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(fps)], names=["node", "fp"])
    rows = lambda *a: sorted(tuple(r.values()) for b in near_copies._cells(*a)([batch]) for r in b.to_pylist())
    assert rows(grids) == sorted(rows(grids[:42], 0) + rows(grids[42:], 42))
