"""Operators that work in blocks or ranges, with small ones, against brute force; and queries that SQL cannot express."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from ragmill.functions import answers
from ragmill.operators import analytics, annotations, caches, matching, ranges, registry, telemetry, vectors
from ragmill.plans import QUERIES


@pytest.mark.parametrize(("chunk", "block", "table", "per_pivot"), [(16384, 4096, 4 << 20, 256), (7, 3, 8, 5), (1000, 1000, 1000, 2)])
def test_vector_search(spark, chunk, block, table, per_pivot, monkeypatch):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("TABLE", table), ("PER_PIVOT", per_pivot)):
        monkeypatch.setattr(vectors, name, value)
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(60)] + [(60, None, 1), (61, [1.0, 2.0, 0.0, 1.0], None)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]  # equal vectors tie
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int").repartition(3)
    asked = df.where("vec_id % 5 = 0")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else math.nan

    known = {i: v for i, v, _ in rows if v is not None}
    want = {}
    for i in known:
        if i % 5 == 0:
            best = sorted((-s, j) for j, v in known.items() if j != i and not math.isnan(s := cosine(known[i], v)))[:4]
            want |= {(i, j): k + 1 for k, (_, j) in enumerate(best)}
    assert {(r["query_id"], r["passage_id"]): r["rank"] for r in vectors.top_by_cosine(asked, df, 4).collect()} == want
    groups = defaultdict(list)
    for _, v, g in rows:
        if v is not None and g is not None:
            groups[g].append(v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    sims = defaultdict(float)
    for i, v, g in rows:
        if i % 5 == 0 and v is not None:
            for d, vs in groups.items():
                sims[g, d] += max(dot(v, x) for x in vs)
    assert {(r["query_group"], r["doc_group"]): r["score"] for r in vectors.max_sim(asked, df).collect()} == sims
    assert vectors.top_by_cosine(asked.limit(0), df, 4).count() == 0 and vectors.top_by_cosine(asked, df.limit(0), 4).count() == 0


def test_pivots_rule_out_cells_and_lose_nothing(spark, monkeypatch):
    """Clustered vectors and a third of all rows equal: most cells are not visited, and the rows are those of a full search."""
    import numpy as np

    monkeypatch.setattr(vectors, "PER_PIVOT", 20)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 8))
    points = [centres[i % 12] + 0.05 * rnd.normal(size=8) for i in range(400)] + [centres[0]] * 200 + [np.zeros(8), np.full(8, np.nan)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, vec array<double>").repartition(4)
    seen, meet = [], vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda corpus, asked, *a: (seen.append((corpus, asked)), meet(corpus, asked, *a))[1])
    got = defaultdict(list)
    for r in vectors.top_by_cosine(df.where("vec_id % 10 = 0"), df, 5).collect():
        got[r["query_id"]].append((r["rank"], r["passage_id"]))
    unit = np.array(points[:600]) / np.linalg.norm(points[:600], axis=1)[:, None]
    for i in range(0, 600, 10):
        s = np.round(unit @ unit[i], 9)
        want = sorted((j for j in range(600) if j != i), key=lambda j: (-s[j], j))[:5]
        assert {j for _, j in got[i]} == set(want) or np.allclose(sorted(s[j] for _, j in got[i]), sorted(s[j] for j in want), atol=1e-9)
        assert [r for r, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
    assert len(got) == 60
    cells = seen[0][0].select("cell").distinct().count()
    assert cells > 8 and seen[1][1].count() + seen[0][1].count() < 60 * cells / 2


def found_in(spark, docs, items):
    out = matching.contained(spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(items, "i long, p string").repartition(2), keep=["d"], text="t", item="i", pattern="p")
    return Counter(map(tuple, out.collect()))


def held(docs, items):
    return Counter((d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t)


@pytest.mark.parametrize("chunk", [1 << 20, 19])
def test_matching(spark, chunk, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    docs = [(1, "the cat sat"), (1, "the cat sat"), (2, "concatenate"), (3, None), (None, "a cat"), (4, "")]
    items = [(10, "cat"), (11, "cat"), (12, ""), (13, None), (14, "at sa"), (15, "catx"), (None, "the")]
    assert found_in(spark, docs, items) == held(docs, items)
    rnd = random.Random(chunk)
    texts = ["".join(rnd.choices("ab \u00e9\U0001f600", k=rnd.choice([0, 5, 40, 300]))) for _ in range(60)] + ["ab" * 100, "a" * 90]
    cuts = [(t, rnd.randrange(len(t) or 1), rnd.choice([0, 1, 2, 3, 4, 7, 15, 16, 17, 24, 60])) for t in texts]
    patterns = [t[a : a + n] for t, a, n in cuts] + ["ba" * 12, "a" * 16, "b" * 30]
    docs, items = list(enumerate([*texts, texts[0], texts[1]])), list(enumerate(patterns))
    assert found_in(spark, docs, items) == held(docs, items)
    assert not found_in(spark, docs, []) and not found_in(spark, [], items)


def test_matching_with_many_hits(spark):
    """One text in a third of all rows, and one gram that all patterns share."""
    docs = [(i, "the common passage of every third document" if i % 3 == 0 else f"text {i} of its own, and not a common one") for i in range(900)]
    items = [(i, p) for i, p in enumerate(["common passage of every", "the common passage of e", "common", "document", "of its own, and not a", *(f"text {i} of its own" for i in range(0, 900, 7))])]
    assert found_in(spark, docs, items) == held(docs, items)


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """One range for few rows, or as many as there are partitions."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_ranges(spark, coalesced):
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), i if i % 9 else 10**12 + i, rnd.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, o long, v long").repartition(4)
    sums = {r["o"]: r["x"] for r in ranges.before(df, ["g"], "o", F.col("v"), "x").collect()}
    tops = {r["o"]: r["x"] for r in ranges.before(df, [], "o", F.col("v"), "x", how="max").collect()}
    for g, o, _ in data:
        assert sums[o] == sum(v for h, p, v in data if h == g and p < o)
        assert tops[o] == max((v for _, p, v in data if p < o), default=None)
    values = sorted(v for _, _, v in data)
    cuts = telemetry.percentiles(df, "v", (10, 50, 99)).first()
    for p, got in zip((10, 50, 99), cuts, strict=True):
        at = p / 100 * (len(values) - 1)
        low = values[math.floor(at)]
        assert math.isclose(got, low + (values[math.ceil(at)] - low) * (at - math.floor(at)), abs_tol=1e-9)
    by = {r["g"]: r["p50"] for r in telemetry.percentiles(df, "v", (50,), ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for h, _, v in data if h == g)
        at = 0.5 * (len(own) - 1)
        assert math.isclose(by[g], own[math.floor(at)] + (own[math.ceil(at)] - own[math.floor(at)]) * (at - math.floor(at)), abs_tol=1e-9)
    points = {(o % 40, v) for _, o, v in data}
    edge = analytics.pareto_frontier(df.select((F.col("o") % 40).alias("o"), "v"), "o", "v")
    assert {tuple(r) for r in edge.collect()} == {(x, y) for x, y in points if not any(a > x and b > y for a, b in points) and y == max(b for a, b in points if a == x)}


def test_empty_ranges(spark):
    df = spark.createDataFrame([], "g string, o long, v long")
    assert ranges.before(df, ["g"], "o", F.col("v"), "x").count() == 0
    assert telemetry.length_summary(df, "v").first().asDict() == {"n": 0, "min": 0, "max": 0, "mean": 0.0, "p50": 0.0, "p90": 0.0}


def test_caches():
    rnd = random.Random(1)
    keys = [rnd.choice([rnd.randint(0, 8), rnd.randint(0, 60)]) for _ in range(4000)]
    lru, arc, seen = caches.Recent(10), caches.Adaptive(10), []
    hits = Counter()
    for k in keys:
        stack = list(OrderedDict.fromkeys(reversed(seen)))
        hit = lru.access(k)
        assert hit == (k in stack[:10])
        hits["lru"] += hit
        held = {*arc.once, *arc.again}
        assert arc.access(k) == (k in held)
        hits["arc"] += k in held
        assert len(arc.once) + len(arc.again) <= 10 and len(arc.once) + len(arc.gone_once) <= 10
        assert len(arc.once) + len(arc.again) + len(arc.gone_once) + len(arc.gone_again) <= 20 and 0 <= arc.target <= 10
        assert k in arc.once or k in arc.again
        seen.append(k)
    assert hits["arc"] >= 0.9 * hits["lru"] > 0


def test_registry(spark):
    df = spark.createDataFrame([("q", 1, 0.5, 2.0, 4), ("q", 2, 0.9, 1.0, 1), ("q", 3, 0.1, 9.0, 2)], "q string, d int, s double, r double, n int")
    out = registry.run_plan(df, [("retrieve", {"by": "q", "score": "s", "tie": "d", "ret_topk": 2}), ("rerank", {"by": "q", "score": "s", "tie": "d", "retriever_score": "r", "length": "n"}), ("project", {"columns": ["d", "rank"]})])
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 2)]
    with pytest.raises(KeyError):
        registry.run_plan(df, [("nothing", {})])
    with pytest.raises(ValueError):
        registry.step("project")(lambda df: df)


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert annotations.enriched(a, a.select("k", F.lit(1).alias("n")), "k").count() == 2
    with pytest.raises(Exception, match="one side only"):
        annotations.enriched(a, a.where("k = 1").select("k", F.lit(1).alias("n")), "k").collect()
    with pytest.raises(ValueError):
        annotations.score_pairs(a.select("k", F.col("v").alias("q")), a.where("k = 1").select("k", F.col("v").alias("d")), "k")
    with pytest.raises(ValueError):
        annotations.stitched(spark, 2, a.select((F.col("k") - 1).alias("row_id"), "v"), "v", 2, 1)
    assert analytics.parse_filters("a=='x,y',b>=2") == [("a", "==", "x,y"), ("b", ">=", "2")]


def test_micro_batches(spark, sf_dir):
    by = defaultdict(list)
    for r in QUERIES["micro_batches"](spark, sf_dir).collect():
        by[r["worker"]].append(r)
    for own in by.values():
        want, now = [], []
        for r in sorted(own, key=lambda r: r["doc_id"]):
            if now and max([*now, r["n_chars"]]) * (len(now) + 1) > 16384:
                want.append(now)
                now = []
            now.append(r["n_chars"])
        got = defaultdict(list)
        for r in sorted(own, key=lambda r: r["doc_id"]):
            got[r["batch"]].append(r["n_chars"])
        assert [got[k] for k in sorted(got)] == [*want, now]


def test_token_batches(spark, sf_dir):
    events = {r["event_id"]: math.ceil(r["value"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    rows = QUERIES["stream_token_batches"](spark, sf_dir).collect()
    assert len({r["row_id"] for r in rows}) == len(rows) and {r["row_id"] for r in rows} <= set(events)
    sums, sizes = Counter(), Counter()
    for r in rows:
        sums[r["grp"], r["batch"]] += events[r["row_id"]]
        sizes[r["grp"], r["batch"]] += 1
    assert all(n <= 2048 or sizes[k] == 1 for k, n in sums.items())
    for g in {g for g, _ in sums}:  # a batch is closed by a row that it has no room for
        own = sorted((r["row_id"], r["batch"]) for r in rows if r["grp"] == g)
        assert [b for _, b in own] == sorted(b for _, b in own)
        assert all(sums[g, b] + events[i] > 2048 for (_, b), (i, c) in zip(own, own[1:]) if c == b + 1)
    assert len({g for g, _ in sums}) > 5


def normalized(text):
    """The metric's rules, word by word and mark by mark."""
    text = text.replace("\n", " ").replace("\t", " ").strip()
    out = text
    for m in answers.MARKS:
        near = m + " " in text or " " + m in text or re.search(r"\d,\d", text)
        out = out.replace(m, "" if near else " ")
    out = re.sub(r"\.(?!\d)", "", out, count=32)
    ws = [answers.NUMBER_WORDS.get(w, w) for w in out.lower().split()]
    return " ".join(answers.CONTRACTIONS.get(w, w) for w in ws if w not in answers.ARTICLES)


def test_answer_consensus(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").collect():
        turns[r["conv_id"]].append((r["turn"], r["text"]))
    rows = QUERIES["answer_consensus"](spark, sf_dir).collect()
    assert len(rows) == len(turns)
    for r in rows:
        golds = [t for _, t in sorted(turns[r["conv_id"]])]
        plain = [t.replace("\n", " ").replace("\t", " ").strip() for t in golds]
        own = [normalized(t) for t in golds] if len(set(plain)) > 1 else plain
        each = [min(1.0, sum(o == own[0] for j, o in enumerate(own) if j != i) / 3) for i in range(len(own))]
        assert math.isclose(r["accuracy"], sum(each) / len(each), abs_tol=1e-6) and r["answer"] == normalized(golds[0])
