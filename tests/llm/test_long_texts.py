"""A long text is judged by all of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ragmill.llm import compression_classifier as cc


def test_long_concatenation_scores_like_its_parts(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = cc.fit(docs, labels)
    held = docs.join(labels.where("quality = 1"), "doc_id").where(cc.held_out(F.col("doc_id"))).orderBy("doc_id").select("text").collect()
    parts = [r["text"].encode() for r in held if r["text"]]
    scorer = cc.Scorer(model.good, model.bad)

    def score(text):
        z = (np.array(scorer.features(text)) - model.centre) / model.scale @ np.array(model.weights[:-1]) + model.weights[-1]
        return 1 / (1 + np.exp(-z))

    whole = b"\n".join(parts)
    whole = (whole * (1 + (4 << 20) // len(whole)))[: 4 << 20]
    scores = {n: score(whole[:n]) for n in (1 << 15, 1 << 17, 1 << 20, 4 << 20)}
    print(scores)
    assert min(scores.values()) >= 0.9
