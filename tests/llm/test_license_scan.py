"""License scans against nested loops over blocks and templates."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ragmill.llm import license_scan as ls
from ragmill.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WRAPPED = "Redistribution and use in source\n * and binary forms, with or without\n * modification, are permitted provided\n * that the following conditions are met:"
AWKWARD = [
    (1, None), (2, ""), (3, "\n\n"), (4, "MIT License"), (5, "mit\n\nLICENSE mit-license; apache license"), (6, "General public licenses"), (7, "The GNU GENERAL Public License"), (8, "Licensed under CC BY-NC 4.0."),
    (9, "x\n" * 9 + WRAPPED), (10, WRAPPED.replace("\n", "\n\n\n")), (11, "Licensed under CC BY-ND 4.0."), (12, "mit licensé K MIT LICENSE\U0001f600 mit license"), (12, "mit licensé K MIT LICENSE\U0001f600 mit license"),
    (None, "Released under the MIT License."), (13, "mit " * 5000 + "license " * 3), (14, "This source code form is subject to terms of the Mozilla Public License v 2.0"), (15, "word " * 30000 + "\n" + WRAPPED),
]


def brute(text, templates=ls.TEMPLATES, threshold=ls.THRESHOLD, lines=ls.LINES):
    low = (text or "").translate(LOWER)
    ws = WORD.findall(low)
    base = [(i, label) for phrase, label in ls.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    labels, best, blocks = {label for _, label in base}, 1.0 if base else 0.0, set()
    split = low.split("\n")
    for i in range(max(len(split) - lines, 0) + 1):
        own = set(WORD.findall("\n".join(split[i : i + lines])))
        for label, t in templates:
            words = set(WORD.findall(t.translate(LOWER)))
            if 10 * len(own & words) >= threshold * len(words):
                labels.add(label)
                blocks.add(i)
                best = max(best, len(own & words) / len(words))
    at = [i for i, _ in base]
    return len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), len(blocks), round(best, 9)


def got(df, **how):
    return sorted(((r[0], *r[1:8], round(r["score"], 9)) for r in ls.scan_licenses(df, **how).collect()), key=str)


def test_rows(spark, sf_dir):
    own = spark.createDataFrame([(i, t, "x", 1) for i, t in AWKWARD], "doc_id long, text string, __key string, row int")
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("x").alias("__key"), F.lit(1).alias("row"))
    docs = own.unionByName(more).repartition(3)
    assert got(docs) == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
    assert got(docs.limit(0)) == []


@pytest.mark.parametrize(("threshold", "lines"), [(5, 1), (6, 3), (8, 2), (10, 4)])
def test_thresholds(spark, threshold, lines):
    """Loose thresholds over few words: many pairs meet, and by every filter some are let through that share too little."""
    rng = random.Random(threshold)
    words = [f"w{i}" for i in range(16)]
    draw = lambda n: " ".join(words[min(15, int(rng.expovariate(0.25)))] for _ in range(n))
    templates = [(f"t{i}", draw(rng.randint(1, 12))) for i in range(9)]
    rows = [(i, "\n".join(draw(rng.randint(0, 9)) for _ in range(rng.randint(1, 7)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, *brute(t, templates, threshold, lines)) for i, t in rows), key=str)
    assert got(docs, templates=templates, threshold=threshold, lines=lines) == want
    assert any(r[7] > 0 for r in want) and any(r[7] == 0 for r in want)


def test_pairs_are_met_once(spark):
    templates = ls.parsed([("a", "one two three"), ("b", "two three four five")], 6)
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two"), (3, "three four")], "doc_id long, text string")
    table = ls.measured(docs, templates, key="doc_id", text="text")
    pairs = [(r["__key"], r["template"]) for r in ls.matches(table, templates, 1).join(table, "row").collect()]
    assert sorted(pairs) == [(1, 0), (1, 1), (2, 0)]


def test_templates_need_words(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for templates in ([], [("a", "...")]):
        with pytest.raises(ValueError):
            ls.scan_licenses(docs, templates=templates)


def test_query_is_native(spark, sf_dir):
    out = queries.queries()["op13_license_scan"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {i: brute(t)[5] for i, t in docs.items()}
    assert any(r["labels"] == "cc-by-nc" for r in rows)
