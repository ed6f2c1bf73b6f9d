"""Decontamination of repeated rows and null ids; a bitmap that lets all shingles through changes no row."""

from __future__ import annotations

from collections import Counter

import pytest

from ragmill.llm import decontamination
from ragmill.operators.matching import BITS

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota"  # five shingles
PART = "alpha beta gamma delta epsilon zeta and then something else"  # two of them


@pytest.mark.parametrize("full", [False, True])
def test_repeated_rows_and_null_ids(spark, full, monkeypatch):
    if full:
        monkeypatch.setattr(decontamination, "bitmap", lambda *_: b"\xff" * (BITS // 8))
    docs = spark.createDataFrame([(1, PART), (1, PART), (2, ITEM), (2, ITEM), (None, ITEM + " end"), (3, "nothing of it here at all"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM)], "item_id long, text string")
    found = decontamination.find_contamination(docs, items).select("doc_id", "item_id", "n_shingles", "n_shared")
    want = Counter({(2, 7, 5, 5): 4, (2, None, 5, 5): 2, (None, 7, 5, 5): 2, (None, None, 5, 5): 1})
    assert Counter(map(tuple, found.collect())) == want
    left = decontamination.drop_contaminated(docs, items)
    assert Counter(r["doc_id"] for r in left.collect()) == {1: 2, 3: 1, 4: 1}
