"""Many rows of one id, and many rows that are alike: results are whole and no group of a sort holds them all."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ragmill.llm import line_dedup, packing, quality_rules, sharding

N = 100_000


@pytest.fixture
def written(monkeypatch):
    """The tables that an operator writes, by name."""
    tables = {}

    def spy(module):
        put = module.shared_table
        monkeypatch.setattr(module, "shared_table", lambda df, name: tables.setdefault(name, put(df, name)))

    for module in (sharding, packing):
        spy(module)
    return tables


@pytest.fixture(scope="module")
def hot(spark):
    """One id, and a half of its rows alike in everything."""
    text = F.when(F.col("id") % 2 == 0, F.lit("the same few words")).otherwise(F.concat(F.lit("row "), F.col("id").cast("string")))
    return spark.range(0, N, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), text.alias("text")).cache()


def test_sharding(hot, written):
    out = sharding.rendezvous_shards(hot, weights=[1.0] * 24)
    shard = {r["shard"] for r in out.select("shard").distinct().collect()}
    assert len(shard) == 1  # the key decides
    slots = out.agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    assert tuple(slots) == (N, N, 0, N - 1)
    assert max(r["count"] for r in written["shards"].groupBy("shard", "__group").count().collect()) < N / 50


def test_packing(hot, written):
    out = packing.pack_documents(hot).cache()
    assert out.count() == N
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("held"), F.count_distinct("offset").alias("d"), F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("held > 2048 or d != n or end != held").count() == 0
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = written["pieces"]
    sizes = Counter({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()})
    parts = {s: -(-n // packing.PIECES) for s, n in sizes.items()}
    share = F.pmod(F.xxhash64("__key", "piece", "ids_crc32", packing.SALT), F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("length")))
    largest = pieces.groupBy("length", share.alias("part")).count().agg(F.max("count")).first()[0]
    assert largest < 2 * packing.PIECES


def test_line_dedup_of_copies(spark):
    """Copies of one record lose the same lines, which are gathered once, not once for each copy."""
    rows = [(1, "a\nb\nc\nd\na\nb\nc")] * 500 + [(2, "x\na\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = line_dedup.covered_lines(docs).collect()
    assert max(len(r["__gone"]) for r in gone) <= 7
    out = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert out == {(1, "a\nb\nc\nd", 3): 500, (2, "x", 3): 1}


def test_ablations_of_an_empty_ledger(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.ablations(quality_rules.ledger(docs), "v2").collect() == []
