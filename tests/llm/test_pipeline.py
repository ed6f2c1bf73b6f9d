"""The pipeline, stage by stage, against brute force; and what its stages do to awkward rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ragmill.llm import quality_rules
from ragmill.llm.common import read, shared_table

from .test_brute_force import PASSAGE, brute_rules, check_places, tokens
from .test_near_copies import brute as near_copies


def fails(text):
    n_words, chars, symbols, dup_lines, repeat = brute_rules(text)
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
    letters = sum(c.isalpha() for c in text)
    return (n_words < 10 or 100 * repeat > 20 * n_words or 100 * symbols > 20 * n_words or 100 * text.count("!") > 30 * n_words
            or lines >= 4 and 100 * dup_lines > 50 * lines or chars > 20 * n_words or n_words > 0 and 2 * letters < chars)


def cut_lines(docs):
    first = {}
    for i, t in sorted(docs.items()):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p : p + 3]), (i, p))
    out = {}
    for i, t in docs.items():
        ls = t.split("\n")
        gone = {q for p in range(len(ls) - 2) if "".join(ls[p : p + 3]).strip(" \t\n\x0b\x0c\r") and first[tuple(ls[p : p + 3])] != (i, p) for q in (p, p + 1, p + 2)}
        left = "\n".join(x for q, x in enumerate(ls) if q not in gone)
        if not gone or left.strip(" "):
            out[i] = left
    return out


def contained(text, items):
    import string

    def shingles(t):
        ws = [w for w in (x.strip(string.punctuation) for x in t.lower().split()) if w]
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    own = shingles(text)
    return any(s and 5 * len(s & own) >= 4 * len(s) for s in map(shingles, items))


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}


def test_stages(spark, sf_dir, small):
    docs, want = read(spark, sf_dir, "documents"), small
    items = [r["text"] for r in read(spark, sf_dir, "benchmark").collect()]

    def near(texts):
        found = near_copies(list(texts.items()))
        return {i: t for i, t in texts.items() if found[i] == i}

    brute = [
        lambda ts: {i: t for i, t in ts.items() if not fails(t)},
        cut_lines,
        near,
        lambda ts: {i: t for i, t in ts.items() if not contained(t, items)},
    ]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        docs, before = shared_table(stage(spark, docs, sf_dir), f"test-{name}"), len(want)
        want = expected(want)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and len(want) < before
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    pieces = Counter()
    for i, t in want.items():
        ids = tokens(t)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, rows))


def test_awkward_rows(spark, sf_dir):
    other = "A wholly different text about rivers and bridges, written with ten words and then some more of them."
    rows = [(1, PASSAGE[:140], "en", "s", 140), (2, PASSAGE[:140], "en", "s", 140), (3, other, None, None, None), (3, other, None, None, None), (4, None, "en", "s", 0), (None, "Nothing here is like the other rows, and its words are its own from the first to the very last.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = defaultdict(list)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i))
    assert kept["quality_rules"] == [1, 2, 3, 3, None]
    assert kept["decontamination"] == [1, 3, None]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    assert quality_rules.mask("v2") == 127
