"""Fill-in-middle rows against a version that cuts the text by slices and units by regular expressions."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragmill.llm import fill_in_middle as fim
from ragmill.llm import queries

UNIT = {"code_points": r"(?s).", "words": r"[ \t-\r]+|[^ \t-\r]+"}
AWKWARD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "has <S> in it"), (6, "almost <P <M and <s>"), (7, "\U0001f600 é\tx\n\n" * 50), (8, "<P>"), (9, "word " * 20000), (9, "word " * 20000), (None, "no id at all"), (-3, "a b c " * 9)]


def brute(key, text, unit="code_points"):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("unit", ["code_points", "words"])
def test_rows(spark, sf_dir, unit):
    own = spark.createDataFrame([(i, t, "x", "y") for i, t in AWKWARD], "doc_id long, text string, __key string, n string")
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x").alias("__key"), F.lit("y").alias("n"))
    docs = own.unionByName(more).repartition(3)
    want = order((r["doc_id"], *brute(r["doc_id"], r["text"], unit)) for r in docs.collect())
    out = fim.fill_in_middle(docs, units=unit).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert order((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out) == want
    assert order((r["doc_id"], r["restored"]) for r in out) == order((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    if unit == "words":
        assert not any(r["splits_word"] for r in out)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.queries()["op11_fill_in_middle"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, a, b, out = brute(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, b, sha(out), sha(texts[r["doc_id"]] or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t<PSM>é\U0001f600", max_size=40), st.integers(), st.sampled_from(["code_points", "words"]))
def test_ranks(text, key, unit):
    ranks = fim.Ranks(text, fim.UNITS[unit], fim.SENTINELS)
    units = re.findall(UNIT[unit], text)
    assert ranks.n == len(units)
    assert [ranks.place(i) for i in range(len(units) + 1)] == [sum(map(len, units[:i])) for i in range(len(units) + 1)]
    assert ranks.marked == any(s in text for s in fim.SENTINELS)
    assert [ranks.inside_word(i) for i in range(len(text) + 1)] == [0 < i < len(text) and not re.search(r"[ \t-\r]", text[i - 1 : i + 1]) for i in range(len(text) + 1)]
    got = fim.transform(key, text, fim.UNITS[unit], fim.SENTINELS, 1, 90, 20)
    assert (*got[:4], got[5]) == brute(key, text, unit)


def test_sentinels_must_differ(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=("<P>", "<P>>", "<M>"))
