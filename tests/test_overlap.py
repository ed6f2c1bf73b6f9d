"""ROUGE of whole turns against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

from ragmill.plans import QUERIES


def brute(p, r):
    a, b, out = p.split(), r.split(), []
    for n in (1, 2):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        out.append(2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values())))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    return [*out, 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0]


def test_words_after_the_fortieth_count(spark, tmp_path):
    head = " ".join(f"w{i}" for i in range(45))
    turns = [(1, head + " a b c a b", "x " * 50 + "a b c b"), (2, "", "one two"), (3, "one", "one"), (4, head, " ".join(reversed(head.split()))), (5, "only one turn", None)]
    rows = [(c, i, "user", t) for c, *both in turns for i, t in enumerate(both) if t is not None]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: [r["rouge1"], r["rouge2"], r["rougeL"]] for r in QUERIES["text_overlap_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4}
    for c, r, p in turns[:4]:
        assert got[c] == pytest.approx(brute(p, r), abs=1e-6), c
    assert got[1][1] > 0
