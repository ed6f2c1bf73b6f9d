"""Scores recomputed from the model, and what the fit may and may not depend on."""

from __future__ import annotations

import math
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from ragmill.llm import compression_classifier as cc


@pytest.fixture(scope="module")
def tables(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return cc.fit(*tables)


def recomputed(model, text):
    data = (text or "").encode()
    sizes = []
    for content in (model.good, model.bad):
        kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == bytes.fromhex("37a430ec") else zstandard.DICT_TYPE_RAWCONTENT
        total = 0
        for i in range(0, len(data), 16384):
            total += len(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind)).compress(data[i : i + 16384]))
        sizes.append(total)
    x = (sizes[1] - sizes[0]) / len(data) if data else 0
    z = model.weights[0] * (x - model.centre[0]) / model.scale[0] + model.weights[1]
    return x, 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_scores(spark, tables, model):
    docs = tables[0].select("doc_id", "text").where("doc_id % 7 = 0")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "long text " * 9000), (None, "short")], "doc_id long, text string")
    rows = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = cc.score_documents(rows, model).collect()
    assert len(got) == len(texts)
    for r in got:
        difference, score = recomputed(model, texts[r["doc_id"]])
        assert math.isclose(r["difference"], difference, abs_tol=1e-12) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_scores_rise_with_the_difference(tables, model):
    rows = sorted((r["difference"], r["score"]) for r in cc.score_documents(tables[0], model).collect())
    assert model.weights[0] > 0 and all(a[1] <= b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_held_out_rows_are_not_learnt_from(tables, model):
    docs, labels = tables
    held = cc.held_out(F.col("doc_id"))
    assert [r["doc_id"] for r in docs.where(held).collect()] == [r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    other = cc.fit(docs.withColumn("text", F.when(held, F.lit("nonsense")).otherwise(F.col("text"))), labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert other == model


def test_repeated_labels_and_texts(spark, tables, model):
    docs, labels = tables
    assert cc.fit(docs.unionByName(docs), labels.unionByName(labels)) == model
    both = labels.withColumn("quality", 1 - F.col("quality")).unionByName(labels)
    assert cc.fit(docs, both).weights[0] == 0.0


def test_long_texts_are_drawn_from_all_over(spark):
    text = b"".join(bytes([i]) * cc.BLOCK for i in range(40)) + b"end"
    df = spark.createDataFrame([(i, text) for i in range(60)], "k long, t binary")
    got = [r["b"] for r in df.select(cc._blocks_of(F.col("t"), F.col("k"), 2 * cc.BLOCK).alias("b")).collect()]
    assert all(len(b) in (2 * cc.BLOCK, cc.BLOCK + 3) for b in got)
    assert len({bytes(b)[0] for b in got}) > 20 and max(bytes(b)[0] for b in got) > 30


def test_plain_dictionary_is_drawn_from_all_over():
    samples = [bytes(f"{i:05d}:{j:05d} ", "ascii") * 43 for i in range(40) for j in range(60)]
    whole = [b"".join(samples[i * 60 : i * 60 + 60]) for i in range(40)]
    made = cc.plain_dictionary(whole)
    assert len(made) <= cc.PLAIN_BYTES and all(f"{i:05d}:".encode() in made for i in range(40))
    assert sum(f":{j:05d}".encode() in made for j in range(60)) == 60
