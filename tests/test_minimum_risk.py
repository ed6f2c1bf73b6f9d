"""Minimum risk under BLEU: texts are shuffled, not their n-grams; questions above a task's words go another way to the same scores."""

from __future__ import annotations

import math
import random

import pytest

from ragmill.operators import ensemble

from .test_proposals import bleu_against


@pytest.mark.parametrize("most", [1 << 17, 60, 0])
def test_scores_whatever_the_size_of_a_question(spark, monkeypatch, most):
    """All questions within a task's words, some of them, none."""
    monkeypatch.setattr(ensemble, "WORDS", max(1, most))
    rnd = random.Random(3)
    groups = {q: [" ".join(rnd.choices("a b c d e The the".split(), k=rnd.randint(0, 12))) for _ in range(q * 3)] for q in range(1, 9)}
    rows = [(q, i, t) for q, ts in groups.items() for i, t in enumerate(ts)]
    got = {r["q"]: (r["i"], r["bleu"]) for r in ensemble.minimum_risk_bleu(spark.createDataFrame(rows, "q long, i long, t string").repartition(4), "q", "i", "t").collect()}
    assert got.keys() == groups.keys()
    for q, ts in groups.items():
        scores = [bleu_against(i, ts) for i in range(len(ts))]
        best = max(range(len(ts)), key=lambda i: (round(scores[i], 9), -i))
        assert got[q][0] == best and math.isclose(got[q][1], scores[best], abs_tol=1e-9)


def test_no_n_gram_is_written_or_shuffled(spark, monkeypatch):
    names, stored = [], ensemble.stored
    monkeypatch.setattr(ensemble, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = spark.createDataFrame([(1, 1, "a b c d e"), (1, 2, "a b c"), (2, 1, "x")], "q long, i long, t string")
    plan = ensemble.minimum_risk_bleu(rows, "q", "i", "t")._jdf.queryExecution().executedPlan().toString()
    assert names == ["sizes"]
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert dealt and not any(" g#" in x or ", n#" in x for x in dealt)


def test_no_rows(spark):
    assert ensemble.minimum_risk_bleu(spark.createDataFrame([], "q long, i long, t string"), "q", "i", "t").count() == 0
