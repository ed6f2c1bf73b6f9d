"""n-gram proposals and minimum risk against plain versions."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragmill.functions import arrays
from ragmill.operators import ensemble


def naive(tokens, low, high, k):
    for n in range(high, low - 1, -1):
        for i in range(len(tokens) - n):
            if tokens[i : i + n] == tokens[len(tokens) - n :]:
                return tokens[i + n : i + n + k]
    return []


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 3), st.integers(0, 4), st.integers(0, 4))
def test_proposals(tokens, low, more, k):
    assert arrays.proposal(tokens, low, low + more, k) == naive(tokens, low, low + more, k)


def test_proposals_take_linear_time():
    began = time.process_time()
    assert arrays.proposal([1] * 300_000 + [2] + [1] * 300_000, 1, 200_000, 3) == [1, 1, 1]
    assert time.process_time() - began < 5


def test_proposals_as_a_column(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2],), (None,), ([],), ([5],)], "t array<int>")
    assert [r[0] for r in df.select(arrays.propose_by_ngram(F.col("t"), 1, 2, 9)).collect()] == [[3, 1, 2], None, [], []]
    assert [r[0] for r in df.select(arrays.propose_by_ngram(F.col("t"), 1, 2, 9, longest=6)).collect()] == [[3], None, [], []]


def bleu_against(i, samples):
    own, others = samples[i].lower().split(), [s.lower().split() for j, s in enumerate(samples) if j != i]
    count = lambda ws, n: Counter(tuple(ws[a : a + n]) for a in range(len(ws) - n + 1))
    logs = []
    for n in range(1, 5):
        matches = sum(sum((count(own, n) & count(o, n)).values()) for o in others)
        if n == 1 and not matches:
            return 0.0
        logs.append(math.log((matches + (n > 1)) / (len(others) * max(len(own) - n + 1, 0) + (n > 1))))
    return min(1.0, math.exp(1 - sum(map(len, others)) / (len(others) * len(own)))) * math.exp(sum(logs) / 4)


def test_minimum_risk(spark):
    """Questions of one sample, of samples without a common word, with ties, and one that holds most of the rows."""
    rnd = random.Random(8)
    words = ["the", "The", "a", "cat", "sat", "on", "mat"]
    groups = {1: ["alone"], 2: ["a b", "c d", ""], 3: ["same text here now", "same text here now", "other"], 4: [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(60)], 5: [None, "x"]}
    rows = [(q, i, t) for q, ts in groups.items() for i, t in enumerate(ts)]
    got = {r["q"]: (r["i"], r["bleu"]) for r in ensemble.minimum_risk_bleu(spark.createDataFrame(rows, "q long, i long, t string").repartition(4), "q", "i", "t").collect()}
    for q, ts in groups.items():
        scores = [bleu_against(i, [t or "" for t in ts]) if len(ts) > 1 else 0.0 for i in range(len(ts))]
        best = max(range(len(ts)), key=lambda i: (round(scores[i], 9), -i))
        assert got[q][0] == best and math.isclose(got[q][1], scores[best], abs_tol=1e-9)


def test_minimum_risk_broadcasts_nothing(spark):
    """Texts that are small enough to be broadcast have n-grams that are not."""
    rows = spark.createDataFrame([(1, 1, "a b c d e"), (1, 2, "a b c"), (2, 1, "x")], "q long, i long, t string")
    plan = ensemble.minimum_risk_bleu(rows, "q", "i", "t")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
