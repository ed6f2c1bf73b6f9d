"""Rows without an id, rows that share one, and long texts: substring removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from ragmill.llm import suffix_dedup


def brute(rows, span=100):
    """A document is an id and a text; null ids first, then by the text's SHA-256."""
    first, per = {}, {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest())):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first.setdefault(b[s : s + span], (i, t, s)) != (i, t, s):
                gone[s : s + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(gone)))
        per[i, t] = (i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return Counter(per[r] for r in rows)


def found(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(df).collect())


def some_text(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choices("abcdefghij klmnop", k=n))


def test_null_and_shared_ids(spark):
    x, y, z = some_text(1, 120), some_text(2, 240), some_text(3, 500)
    rows = [(None, x + x), (None, y), (None, y), (None, z[100:400]), (4, z), (4, z[50:] + x), (4, z), (5, y + z), (-(1 << 63), y[:150] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == brute(rows)
    alone = [(None, x + x), (None, y)]
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup_substrings(spark.createDataFrame(alone, "doc_id long, text string")).collect()) == [0, 120]


def test_text_beyond_a_block(spark):
    """Above 1 MiB a text is hashed in blocks; what repeats across their borders goes all the same."""
    own = some_text(7, 1_300_000)
    border = (1 << 19) - 70
    long = own[:border] + own[1000:1300] + own[border:] + own[(1 << 19) - 40 : (1 << 19) + 200]
    assert len(long) > 1 << 20
    rows = [(1, long), (2, own[700_000:700_150] + "x" + some_text(8, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
