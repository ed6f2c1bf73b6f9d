"""Functions on hand-made values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ragmill.functions import answers as A
from ragmill.functions import arrays as X
from ragmill.functions import text as T
from ragmill.operators import analytics as N
from ragmill.operators import curation as C
from ragmill.operators import ensemble as E
from ragmill.operators import mixing as M
from ragmill.operators import retrieval as R
from ragmill.operators import scoring as S
from ragmill.sources import readers, sinks


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        return one.select(column.alias("x")).first()["x"]

    return get


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs])


def numbers(*xs):
    return F.array(*[F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in xs])


def test_answers(value):
    norm = lambda s: value(A.normalize_answer(F.lit(s)))
    assert norm("The  two dogs.") == "2 dogs"
    assert norm("a-b") == "b"  # the hyphen becomes a space, then the article goes
    assert norm("red, blue") == "red blue"
    assert norm("1,000 a/b") == "1000 ab"
    assert norm("3.5 metres.") == "3.5 metres"
    assert norm("dont know") == "don't know"
    assert norm("x" + "." * 40) == "x" + "." * 8
    assert value(A.consensus(F.lit("two"), strings("2", "two", "2", "three"))) == pytest.approx((2 / 3 * 3 + 1) / 4)
    assert value(A.consensus(F.lit("The cat"), strings("cat", "cat", "cat"))) == 0.0  # alike answers are not normalised
    assert value(A.needle_score(F.lit("It says: The  Key is 7."), F.lit("the key IS 7"))) == 10
    assert value(A.needle_score(F.lit("the key is lost"), F.lit("the key is seven"))) == 5
    assert value(A.needle_score(F.lit(None).cast("string"), F.lit("x"))) == 1
    assert value(A.needles_score(F.lit("a and b"), strings("a", "b", "zz", "yy"))) == 5
    assert value(A.needles_score(F.lit("a b"), strings("a", " b "))) == 10


def test_text(value):
    assert value(T.truncate_words(F.lit("a  b c"), 3)) == "a  b"
    assert value(T.truncate_words_anywhere(F.lit(" a \n b c"), 2)) == "a b"
    assert value(T.count_words(F.lit(None).cast("string"))) == 0
    assert value(T.sliding_chunks(F.lit("a b c d e"), size=3, overlap=1)) == ["a b c", "c d e", "e"]
    assert value(T.sliding_chunks(F.lit("a b c d e"), parts=2, overlap=0)) == ["a b c", "d e"]
    assert value(T.sliding_chunks(F.lit("  "))) == [""]
    assert value(T.overlaps_next(strings("a b c", "c d e", "x"), 1)) == [True, False]
    assert value(T.title_of(F.lit("W_Eiffel_3"))) == "Eiffel" and value(T.title_of(F.lit("x"))) == ""
    assert value(T.base_document_id(F.lit("doc_7_12"))) == "doc_7" and value(T.base_document_id(F.lit("doc"))) == "doc"
    assert value(T.fill("<<QUESTION>> {{name}} {{name}}", True, question=F.lit("q"), name=F.lit("n"))) == "q n {{name}}"
    assert value(T.after_first(F.lit("a[ANSWER]b[ANSWER]c"))) == "b[ANSWER]c" and value(T.after_last(F.lit("a[ANSWER]b[ANSWER] c"))) == "c"
    assert value(T.judge_score(F.lit("Score: 0.7"))) == 0.7 and value(T.judge_score(F.lit("none"))) == 0.0
    assert value(T.last_integer(F.lit("so 1,234 and 7"))) == 7 and value(T.last_integer(F.lit("?"))) == -9999999
    assert value(T.violates_format(strings("q", "[THINK] x", "[RETRIEVE] a [ANSWER]")))
    assert not value(T.violates_format(strings("q", "\n[THINK] x", "[ANSWER] y")))
    assert value(T.agent_action(F.lit("RETRIEVE_SEARCH(old bridge)")))["argument"] == "old bridge"
    prompt = "[1] one\ntwo\n[2] three\nImage Quotes are:\nimage1 is described as: a cat\nThe user question is: why?"
    assert [tuple(x) for x in value(T.text_quotes(F.lit(prompt)))] == [("text1", "one two"), ("text2", "three")]
    assert [tuple(x) for x in value(T.image_quotes(F.lit(prompt)))] == [("image1", "a cat")]
    assert value(T.question_of(F.lit(prompt))) == "why?"
    assert value(T.page_numbers(strings("page_5", "5", " 7 ", "x"))) == [5, 7]
    assert value(T.slide_paths(F.lit("d/s_page_1.png"), F.array(F.lit(4)))) == ["d/s_page_4.png"]
    assert tuple(value(T.run_parameters(F.lit("K=5-TakeN=100-TopK=20")))) == (5, 100, 20, 1.0)
    assert value(T.parse_list(F.lit("['a', \"b\"]"))) == ["a", "b"] and value(T.parse_list(F.lit('["x"]'))) == ["x"] and value(T.parse_list(F.lit("y"))) == ["y"]
    rewrites = value(T.rewritten_queries("rewrite", F.lit("q"), F.lit("- Rewrite 1: one\n- Rewrite 2: two"), strings("a_b"), strings("d")))
    assert rewrites == ["one", "two"]


def test_arrays(value):
    assert value(X.softmax(numbers(1, 1))) == [0.5, 0.5] and value(X.softmax(F.slice(numbers(1), 1, 0))) == []
    assert value(X.logsumexp(numbers(1000, 1000))) == pytest.approx(1000 + math.log(2))
    assert value(X.entropy(numbers(0.5, 0.5, 0))) == pytest.approx(math.log(2))
    assert value(X.argsort_desc(numbers(1, None, 3, 1))) == [2, 0, 3]
    assert tuple(value(X.sequence_budget(F.lit(100), F.lit(100), 100))) == (50, 50)
    assert tuple(value(X.sequence_budget(F.lit(10), F.lit(200), 100))) == (10, 90)
    assert value(X.pad(F.array(F.lit(1)), 3, 0)) == [1, 0, 0]
    assert value(X.swap(strings(*"abc"), F.lit(0), F.lit(2))) == list("cba")
    assert value(X.common_prefix(F.array(strings(*"abc"), strings(*"abd")))) == ["a", "b"]
    assert value(X.chunked(strings(*"abc"), 2)) == [["a", "b"], ["c"]] and value(X.chunked(F.slice(strings("a"), 1, 0), 2)) == []
    assert value(X.resolve_index(F.lit(-1), F.lit(3))) == 2 and value(X.resolve_index(F.lit(3), F.lit(3))) is None
    assert value(X.cyclic_slice(strings(*"abc"), F.lit(2), 4)) == list("cabc")
    assert value(X.interior_points(F.lit(0.0), F.lit(10.0), 3)) == [2, 5, 8]
    tokens = F.array(*[F.lit(x) for x in (1, 2, 3, 9, 1, 2)])
    assert value(X.propose_by_ngram(tokens, 1, 3, 2)) == [3, 9]
    assert value(X.max_sim(F.array(numbers(1, 0)), F.array(numbers(0, 1), numbers(2, 0)))) == 2.0
    assert value(X.min_p(numbers(0, -10), 0.1)) == [0.0, None]
    assert value(X.ends_with(tokens, F.array(F.lit(1), F.lit(2))))
    assert value(X.penalized(numbers(2, -2, 1), F.array(F.lit(1), F.lit(1), F.lit(0)), repetition=2.0)) == [1.0, -4.0, 1.0]


def test_branch_report(spark):
    rows = [("p2", ["p1", "p2"], ["p1", "p2"], ["p2", "p1"]), ("p9", [], [], [])]
    out = R.branch_report(spark.createDataFrame(rows, "gold_id string, retrieved array<string>, prior_sorted array<string>, posterior_sorted array<string>"), 2).first()
    assert (out["retrieval_hit_rate"], out["prior_hit_rate"], out["posterior_hit_rate"], out["prior_recall_at_2"]) == (0.5, 0.0, 0.5, 0.5)


def test_ranked_lists(spark, value):
    entry = "array<struct<passage_id:string,text:string,rerank_score:double>>"
    lists = spark.createDataFrame([([("a", "x", 1.0), ("b", "x", None), ("c", "y", 2.0), ("d", "z", 1.0)],)], f"p {entry}")
    ids = lambda c: [p["passage_id"] for p in lists.select(c.alias("x")).first()["x"]]
    assert ids(R.rerank(F.col("p"))) == ["c", "a", "d", "b"] and ids(R.deduplicated(F.col("p"))) == ["a", "c", "d"]
    assert value(R.first_hit(strings(*"abc"), strings("c", "b"))) == 2 and value(R.first_hit(strings("a"), strings("b"))) is None
    assert value(R.overlap(F.slice(strings("a"), 1, 0), strings("a"), 5)) is False


def test_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("a", float("nan")), (None, 2.0)], "n string, x double")
    assert N.apply_filters(df, "x<inf").count() == 2 and N.apply_filters(df, "x==inf,n=='b'").count() == 1
    assert N.apply_filters(df, "n!=a").count() == 2 and N.apply_filters(df, "").count() == 4
    with pytest.raises(ValueError, match="not a filter"):
        N.apply_filters(df, "x ~ 3")


def test_run_tables(spark):
    a = spark.createDataFrame([("m", 1, 10.0), ("m", 2, 0.0)], "model string, k int, x double")
    b = spark.createDataFrame([("m", 1, 25.0), ("m", 2, 1.0), ("m", 3, 1.0)], "model string, k int, x double")
    assert {(r["k"], r["ratio"]) for r in N.compare_runs(a, b, ["model", "k"], "x").collect()} == {(1, 2.5), (2, None)}
    beams = spark.createDataFrame([(0, ["s", "t"], [0.1, 0.9]), (1, ["s"], [0.4])], "seg int, states array<string>, w array<double>")
    assert {(r["state"], r["0"], r["1"]) for r in N.heatmap(beams, "states", "w", "seg", [0, 1]).collect()} == {("s", 0.1, 0.4), ("t", 0.9, 0.0)}
    labels = spark.createDataFrame([("mm_8x16", 2.0), ("mm_8x16", 1.0), ("other", 3.0)], "label string, ms double")
    placed = N.grouped_by_label(labels, "label", r"mm_(\d+)x(\d+)", ["m", "n"], "ms").select("m", "n", "ms", "place", "of").collect()
    assert sorted(map(tuple, placed)) == [("8", "16", 1.0, 0, 2), ("8", "16", 2.0, 1, 2)]


def test_conversations(spark, value):
    schema = "c array<struct<from:string,value:string>>"
    df = spark.createDataFrame([([("system", "s"), ("gpt", "x"), ("human", "h"), ("gpt", "g"), ("robot", "r")],)], schema)
    out = [(m["role"], m["content"]) for m in df.select(C.openai_messages(F.col("c"), 2).alias("m")).first()["m"]]
    assert out == [("user", "h"), ("assistant", "g")]
    shared = df.select(C.from_shared(F.col("c")).alias("m")).first()["m"]
    assert [(m["role"], m["loss_weight"]) for m in shared] == [("system", 0.0), ("assistant", 1.0), ("user", 0.0), ("assistant", 1.0)]
    parts = spark.createDataFrame([([[("user", "a")], [("user", "b"), ("assistant", "c")], [("assistant", "d")], [("assistant", "e")]],)], "p array<array<struct<role:string,content:string>>>")
    assert [m["content"] for m in parts.select(C.join_parts(F.col("p")).alias("m")).first()["m"]] == ["a", "c"]
    assert value(C.multiple_choice(F.lit("Q"), strings("x", "y"), F.lit(" B"))) == "Q\nA. x\nB. y\nAnswer: B"


def test_packing_rows(spark):
    df = spark.createDataFrame([(0, 1, [5, 6], [-100, 6]), (0, 2, [7], [7])], "k int, o int, ids array<int>, labels array<int>")
    out = M.packed_rows(df, ["k"], "ids", "labels", "o", 4).first()
    assert (out["input_ids"], out["labels"], out["position_ids"], out["sequence_ids"], out["boundaries"]) == ([5, 6, 7, 0, 0], [-100, 6, 7, -100, -100], [0, 1, 0, 0, 0], [1, 1, 2, 0, 0], [2, 3])


def test_mixing(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(5)], "s string, i long")
    assert M.interleave(df, "s", "i", "all_exhausted").count() == 10
    drawn = M.mix_by_weight(df, "s", "i", {"a": 3.0, "b": 1.0}, 400, 1).groupBy("s").count().collect()
    assert 260 < {r["s"]: r["count"] for r in drawn}["a"] < 340
    numbered = M.numbered(df, ["s"], F.col("i")).collect()
    assert sorted((r["s"], r["row_id"]) for r in numbered) == [("a", i) for i in range(3)] + [("b", i) for i in range(5)]
    assert C.resample(M.running(df.withColumn("g", F.lit(0)), ["g"], "i", F.lit(1), "row_id"), 20, 8, "row_id", 3).count() >= 20
    with pytest.raises(ValueError, match="neither"):
        M.routes({"test": df})
    assert set(M.routes({"train": df, "validation_x": df})) == {"train_dataset", "eval_dataset_x"}


def test_scores(spark, value):
    pairs = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b", "a c")], "p string, r string")
    assert 0 < S.corpus_bleu(pairs, "p", "r").first()["bleu"] <= 100
    assert S.corpus_bleu(pairs.limit(1), "p", "r").first()["bleu"] == pytest.approx(100)
    assert value(S.rouge_l(F.lit("a b c d"), F.lit("a x c d"))) == pytest.approx(0.75)
    assert value(S.rouge_n(F.lit("a a b"), F.lit("a c"), 1)) == pytest.approx(2 / 5)
    candidates = spark.createDataFrame([("q", 0, "x y"), ("q", 1, "x y z"), ("q", 2, "k")], "question string, sample int, text string")
    best = E.minimum_risk(candidates, "question", "text", lambda a, b: S.rouge_n(a, b, 1)).first()
    assert best["text"] == "x y"
    assert value(E.token_accuracy(F.array(*map(F.lit, (5, 6, 7))), F.array(*map(F.lit, (-100, 5, 9))))) == 0.5
    fails = S.pluggable(lambda q, refs, c: 1 / 0, on_error=0.5)
    assert pairs.select(fails("p", F.array("r"), "r").alias("s")).first()["s"] == 0.5


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "['a', 'b']"), (2, "['c']")], "id long, xs string")
    base = f"file://{tmp_path}"
    sinks.save(df, f"{base}/t.csv", "csv")
    back = readers.load(spark, f"{base}/t.csv", list_columns=["xs"])
    assert {tuple(r["xs"]) for r in back.collect()} == {("a", "b"), ("c",)}
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "c.csv").write_text("q1,A,B\nq2,C,D\n")
    assert readers.load(spark, f"{base}/a.json").count() == readers.load(spark, f"{base}/b.jsonl").count() == 2
    assert readers.load(spark, f"{base}/c.csv", names=["q", "a", "b"]).columns == ["q", "a", "b"]
    with pytest.raises(ValueError, match="no reader"):
        readers.format_of("x.docx")
    registry = readers.Registry({"t": {"path": f"{base}/t.csv", "columns": {"key": "id"}, "num_samples": 1}})
    assert registry.table(spark, "t").columns == ["key"] and registry.table(spark, "t").count() == 1
    with pytest.raises(KeyError):
        registry.table(spark, "u")
    assert sinks.append_unfinished(df, f"{base}/log", "id") == 2 and sinks.append_unfinished(df, f"{base}/log", "id") == 0
    assert sinks.table_text(df.select("id").orderBy("id")).splitlines()[0] == "| id |"
    assert {r["n_rows"] for r in sinks.save_variants(df.withColumn("v", F.col("id")), "v", f"{base}/v").collect()} == {1}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "summary.csv").write_text("Tasks,a,b\nScore,1.5,2\n")
    rows = readers.wide_summaries(readers.whole_texts(spark, f"{base}/s", "summary.csv")).collect()
    assert {(r["task"], r["score"]) for r in rows} == {("a", 1.5), ("b", 2.0)}
    assert readers.choose_split(["train", "dev"]) == "dev"
