"""Every query with SQL against DuckDB on the smallest tables, and properties of those without."""

from __future__ import annotations

import glob
import os
from collections import defaultdict

import duckdb
import pytest

from ragmill.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def flat(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted(tuple(flat(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(flat(r[i]) for i in at) for r in rel.fetchall())


def test_knapsacks(spark, sf_dir):
    import bisect

    rows = QUERIES["greedy_knapsack"](spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["batch"]].append(r)
    for own in by.values():
        left, k, want = sorted(r["n_chars"] for r in own if r["n_chars"] <= 8192), 0, {}
        while left:
            room = 8192
            while (i := bisect.bisect_right(left, room)) > 0:
                room -= left[i - 1]
                want.setdefault(k, []).append(left.pop(i - 1))
            k += 1
        got = defaultdict(list)
        for r in own:
            if r["knapsack"] >= 0:
                got[r["knapsack"]].append(r["n_chars"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("name", ["micro_batches", "answer_consensus", "text_overlap_scores", "stream_token_batches"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
