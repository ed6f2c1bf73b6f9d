"""States that merge, and the table function."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ragmill.functions.tables import register
from ragmill.operators.states import Ledger
from ragmill.sources.folders import exists, new_path, stored, sweep


def test_runs_merge_to_the_whole(spark):
    """Runs of unequal sizes, values far from zero, nulls, a group that one run lacks; a repeated run counts once; a dump starts anew."""
    rnd = random.Random(2)
    rows = [(rnd.choice("abc") if i > 50 else "a", None if i % 17 == 0 else 1e9 + rnd.random()) for i in range(600)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    ledger = Ledger(spark, new_path(spark, "test-states"), ["g"], {"x": F.col("x")})
    with pytest.raises(ValueError):
        ledger.values()
    cuts = {"one": rows[:30], "two": rows[30:500], "three": rows[500:]}
    for run, part in [*cuts.items(), ("two", cuts["two"])]:
        ledger.add(run, spark.createDataFrame(part, "g string, x double"))
    assert ledger.runs() == sorted(cuts)
    for take in (ledger.values, ledger.dump):
        got = {r["g"]: r for r in take().collect()}
        for g in ("a", "b", "c"):
            xs = [x for h, x in rows if h == g and x is not None]
            r = got[g]
            assert r["count"] == len(xs) and r["min"] == min(xs) and r["max"] == max(xs)
            assert abs(r["mean"] - statistics.fmean(xs)) < 1e-6 and abs(r["variance"] - statistics.variance(xs)) < 1e-6
            assert abs(r["distinct"] - len(set(xs))) <= 0.05 * len(xs)
        assert got["empty"]["count"] == 0 and got["empty"]["mean"] is None and got["empty"]["variance"] is None
    assert ledger.runs() == []
    ledger.add("four", df.where("g = 'b' and x is not null").limit(1))
    assert [r["count"] for r in ledger.values().collect()] == [1]


def chunks(words, size, overlap):
    out, at = [], 0
    while words:
        out.append(words[at : at + size])
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (3, 0), (5, 4), (1, 0), (100, 7)])
def test_chunk_rows(spark, size, overlap):
    register(spark)
    rnd = random.Random(size)
    rows = [(g, i, " ".join(rnd.choices(["a", "b", "c"], k=rnd.choice([0, 1, 2, 9])))) for g in range(6) for i in range(rnd.randint(0, 5))] + [(7, 0, None), (7, 1, " ")]
    spark.createDataFrame(rows, "g long, i long, t string").createOrReplaceTempView("rows_to_chunk")
    got = spark.sql(f"select * from chunk_rows(table(rows_to_chunk) partition by g order by i, text => 't', size => {size}, overlap => {overlap})")
    assert got.columns == ["g", "i", "chunk", "n_words", "n_rows", "words"]
    want = []
    for g in range(6):
        words = [(w, i) for h, i, t in rows if h == g for w in t.split()]
        want += [(g, c[0][1], n, len(c), len({i for _, i in c}), " ".join(w for w, _ in c)) for n, c in enumerate(chunks(words, size, overlap))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("arguments", ["text => 'none', size => 3", "text => 'i', size => 3", "text => 't', size => 3, overlap => 3"])
def test_chunk_rows_refuses(spark, arguments):
    register(spark)
    spark.createDataFrame([(1, "x")], "i long, t string").createOrReplaceTempView("rows_to_chunk")
    with pytest.raises(Exception, match="no text column|smaller than the size"):
        spark.sql(f"select * from chunk_rows(table(rows_to_chunk), {arguments})").collect()


def test_sweep(spark):
    path = new_path(spark, "test-sweep")
    spark.range(3).write.parquet(path)
    kept = stored(spark.range(5), "test-sweep")
    assert exists(spark, path) and kept.count() == 5
    assert sweep(spark) >= 2 and not exists(spark, path) and sweep(spark) == 0
