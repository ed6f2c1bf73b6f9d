"""Queries over text, array and conversation functions, orders and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import arrays as X
from ..functions import base as B
from ..functions import text as T
from ..operators import analytics as N
from ..operators import annotations as Q
from ..operators import curation as C
from ..operators import ensemble as E
from ..operators import mixing as M
from ..operators import registry
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import telemetry as L
from ..sources import readers
from .base import lines, query, read


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# Text


@query("""select c_custkey::bigint c_custkey, 'yes ' || c_name as first_answer, c_name as last_answer, 'x "' || c_mktsegment || '" "b' as cleaned, c_custkey % 2 = 1 as violated,
 case c_custkey % 4 when 0 then 'search' when 1 then 'view' when 2 then 'next_page' else 'answer' end kind, case c_custkey % 4 when 0 then c_name when 1 then c_nationkey::varchar when 2 then 'RETRIEVE_NEXTPAGE' else ' ' || c_name end argument, (c_custkey % 3 = 0)::int reward from customer""")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the first and the last answer mark, a cleaned answer, the format check, an agent's action, and exact-match rewards."""
    c = read(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(F.lit("t [ANSWER]yes "), name)
    two = F.concat(F.lit("a [ANSWER] b [ANSWER] "), name)
    raw = F.concat(F.lit('\nx "'), "c_mktsegment", F.lit("\"' '\" ', '"), F.lit("b\n"))
    said = F.array(F.lit("start"), F.when(k % 2 == 1, "no mark").otherwise("[THINK] a [RETRIEVE] q [RETRIEVE] x"))
    act = F.when(k % 4 == 0, F.concat(F.lit("do RETRIEVE_SEARCH("), name, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("RETRIEVE_VIEW("), F.col("c_nationkey").cast("string"), F.lit(")"))).when(k % 4 == 2, F.lit("RETRIEVE_NEXTPAGE")).otherwise(F.concat(F.lit("[ANSWER] "), name))
    a = T.agent_action(act)
    return c.select(_long("c_custkey"), T.after_first(text).alias("first_answer"), T.after_last(two).alias("last_answer"), T.clean_answer(raw).alias("cleaned"), T.violates_format(said).alias("violated"), a["kind"].alias("kind"), a["argument"].alias("argument"), T.exact_match(name, F.when(k % 3 == 0, name)).alias("reward"))


@query("""select p_partkey::bigint p_partkey, p_name as q1, p_type as q2, 'text3=' || p_name || '|text7=' || p_type as quotes, 'image2=' || p_brand as images, 'why ' || p_name || '?' as question from part""")
def quote_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered quotes, image descriptions and the question out of a prompt."""
    p = read(spark, sf_dir, "part")
    prompt = F.concat(F.lit("Quotes:\n[3] "), "p_name", F.lit("\n[7]  "), "p_type", F.lit("\nImage Quotes are:\nimage2 is described as: "), "p_brand", F.lit("\nThe user question is: why "), "p_name", F.lit("?"))
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["quote_id"], F.lit("="), x["text"])), "|")
    return p.select(_long("p_partkey"), F.col("p_name").alias("q1"), F.col("p_type").alias("q2"), shown(T.text_quotes(prompt)).alias("quotes"), shown(T.image_quotes(prompt)).alias("images"), T.question_of(prompt).alias("question"))


@query("""select s_suppkey::bigint s_suppkey, '5,' || s_nationkey as pages, 'd/x_page_5.png' as first_path, case s_suppkey % 4 when 0 then 'a|b' when 1 then s_name when 2 then 'c|d' else '' end listed,
 (s_suppkey % 9)::int k, case when s_suppkey % 2 = 0 then 0.5 else 1.0 end::double top_p, 1 - 1 / (2.0 * (s_suppkey % 9 + 1)) pruned from supplier""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers, slide paths, lists read from text, parameters read from a run's name, and the share that K branches are pruned to."""
    s = read(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    pages = T.page_numbers(F.array(F.lit("page_5"), F.lit(" 5 "), F.lit(""), F.concat(F.lit("page_"), n)))
    shown = F.when(F.size(pages) == 1, F.array(F.lit(5), F.lit(5))).otherwise(pages)
    listed = T.parse_list(F.when(k % 4 == 0, F.lit('["a", "b"]')).when(k % 4 == 1, F.col("s_name")).when(k % 4 == 2, F.lit("['c', 'd']")).otherwise(F.lit(" ")))
    run = T.run_parameters(F.concat(F.lit("Run-K="), (k % 9).cast("string"), F.when(k % 2 == 0, "-TopP=0.5").otherwise("")))
    return s.select(_long("s_suppkey"), F.array_join(shown.cast("array<string>"), ",").alias("pages"), F.get(T.slide_paths(F.lit("d/x_page_12.png"), pages), 0).alias("first_path"), F.array_join(listed, "|").alias("listed"), run["k"].alias("k"), run["top_p"].alias("top_p"), B.top_p_for(k % 9 + 1).alias("pruned"))


@query("""select doc_id::bigint doc_id, ('0x' || left(sha256(doc_id::varchar), 15))::bigint as seed15, case when len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x != '')) >= 20 then length(regexp_extract(coalesce(text, ''), '^((?:\\s*\\S+){0,20})', 1)) else length(coalesce(text, '')) end::int cut, true as overlaps from documents""")
def token_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed from a hash, texts cut at their 20th token, and neighbouring chunks that overlap as they should."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = T.stable_number(F.col("doc_id").cast("string"))
    chunks = T.sliding_chunks(F.col("text"), size=30, overlap=10)
    # The last windows are suffixes, shorter than the overlap.
    fine = B.let(T.overlaps_next(chunks, 10), lambda x: F.forall(F.slice(x, 1, F.greatest(F.size(x) - 2, F.lit(0))), lambda y: y))
    return d.select(_long("doc_id"), F.floor(n / 16).cast("long").alias("seed15"), F.length(T.truncate_tokens(F.col("text"), 20)).alias("cut"), fine.alias("overlaps"))


@query("""select event_id::bigint event_id, greatest(value, (event_id % 9)::double) best from events""")
def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of several sub-scores, missing ones aside."""
    e = read(spark, sf_dir, "events")
    return e.select(_long("event_id"), B.best_of(F.col("value"), (F.col("event_id") % 9).cast("double"), F.lit(None).cast("double")).alias("best"))


@query("""select conv_id::bigint conv_id, list_filter(list({'r': role, 't': text} order by turn), lambda x: x.r = 'user' and x.t != '')[1].t as context, coalesce(list_filter(list({'r': role, 't': text} order by turn), lambda x: x.r = 'user')[2].t, '') question from conversations group by 1 having count(*) >= 3""")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and question of prompts of three turns or more: the first two user turns."""
    c = _turns(spark, sf_dir).where(F.size("m") >= 3)
    p = T.context_and_question(F.col("m"))
    return c.select("conv_id", p["context"].alias("context"), p["question"].alias("question"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("e"))
    return c.select("conv_id", F.transform("e", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


@query("""with c as (select conv_id, list(role order by turn) r, list(text order by turn) t from conversations group by 1 having count(*) >= 3),
p as (select conv_id, r[1] r, t[2] || t[1] || ' ' || t[1] || t[3] plain, t[2] || trim('<image> ' || t[3]) || ' ' || t[1] || t[3] pictured from c)
select conv_id::bigint conv_id, greatest(len(list_filter(regexp_split_to_array(plain, '\\s+'), lambda x: x != '')),
 len(list_filter(regexp_split_to_array(pictured, '\\s+'), lambda x: x != '')) + case r when 'user' then 5 when 'system' then 90 else 0 end)::int as length from p""")
def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the longest prompt that a passage makes, its largest image counted: first turns are passages and evidence, and the role of
    the first names an image of known size or none."""
    c = _turns(spark, sf_dir).where(F.size("m") >= 3)
    t = lambda i: F.get("m", i)["content"]
    turns = F.array(t(1), F.concat(F.lit("<<<EVIDENCE>>> "), t(0)), t(2))
    none = F.array().cast("array<string>")
    passages = F.array(F.struct(t(0).alias("text"), none.alias("images")), F.struct(t(2).alias("text"), F.array(F.get("m", 0)["role"]).alias("images")))
    n = T.example_length(turns, passages, none, F.create_map(F.lit("user"), F.lit(5), F.lit("system"), F.lit(90)))
    return c.select("conv_id", n.cast("int").alias("length"))


@query("""with c as (select c_custkey, c_name q, 'id_' || c_mktsegment || '_1' i1, 'id_N' || c_nationkey i2, c_mktsegment d1, repeat(c_name, 300) d2, '- Rewrite 1: ' || c_mktsegment || chr(10) || '- Rewrite 2: N' || c_nationkey || chr(10) || '- Answer 1: ' || c_mktsegment || case when c_custkey % 2 = 0 then chr(10) || '- TITLE: T' || c_nationkey || chr(10) || '- CONTENT: ' || c_mktsegment else '' end r, c_custkey % 2 = 0 full_, c_nationkey n from customer)
select c_custkey::bigint c_custkey, m as method, unnest(case m when 'rewrite' then [d1, 'N' || n] when 'rewrite_with_reasoning' then [d1, 'N' || n] when 'expand_with_answer' then [q || ' ' || d1]
 when 'question_and_gold_document' then [q || ' ' || d1, q || ' ' || left(d2, 4096)] when 'gold_document' then [d1, left(d2, 4096)] when 'question_and_gold_entity' then [q || d1, q || 'N' || n] when 'gold_entity' then [d1, 'N' || n]
 when 'question_and_generated' then [q || r] when 'generated' then [r] when 'question_and_generated_plain' then [case when full_ then q || ' T' || n || ' ' || d1 else q || r end] else [case when full_ then q || ' T' || n else q || r end] end) as query
from c, (select unnest(['rewrite', 'rewrite_with_reasoning', 'expand_with_answer', 'question_and_gold_document', 'gold_document', 'question_and_gold_entity', 'gold_entity', 'question_and_generated', 'generated', 'question_and_generated_plain', 'question_and_generated_entity']) m)""")
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that each of the rewriting methods makes out of a customer's fields, one row each."""
    n = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    whole = F.concat(F.lit("\n- TITLE: T"), F.col("c_nationkey").cast("string"), F.lit("\n- CONTENT: "), "c_mktsegment")
    response = F.concat(F.lit("- Rewrite 1: "), "c_mktsegment", F.lit("\n- Rewrite 2: "), n, F.lit("\n- Answer 1: "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, whole).otherwise(""))
    ids, texts = F.array(F.concat(F.lit("id_"), "c_mktsegment", F.lit("_1")), F.concat(F.lit("id_"), n)), F.array("c_mktsegment", F.repeat("c_name", 300))
    made = F.map_from_arrays(F.array(*[F.lit(m) for m in T.REWRITES]), F.array(*[T.rewritten_queries(m, F.col("c_name"), response, ids, texts) for m in T.REWRITES]))
    return read(spark, sf_dir, "customer").select(_long("c_custkey"), F.explode(made).alias("method", "q")).select("c_custkey", "method", F.explode_outer("q").alias("query"))


# Arrays


@query("""with e as (select vec_id, [vec_id % 5, vec_id % 3, 2, 1, vec_id % 5]::int[] x from embeddings)
select vec_id::bigint vec_id, array_to_string(list_concat([-100, -100], x), ',') masked, array_to_string(list_resize(x, 7, 0), ',') padded, array_to_string(x[1:3], ',') cut, array_to_string(list_filter([-1, 0, (vec_id % 9)::int, 4], lambda i: i between 0 and 4), ',') gold,
 (case when vec_id % 11 < 5 then 4 - vec_id % 11 end)::int resolved, array_to_string(list_transform(range(0, 4), lambda j: x[(vec_id + j) % 5 + 1]), ',') cyclic, len(list_filter(x, lambda v: v >= 2))::int at_least, (vec_id % 3 = 1 and vec_id % 5 = 1)::boolean ends from e""")
def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked labels, padding and cutting, gold indices in range, negative indices, cyclic slices, ranks, and endings."""
    v = F.col("vec_id")
    i = lambda x: x.cast("int")
    x = F.array(i(v % 5), i(v % 3), F.lit(2), F.lit(1), i(v % 5))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    e = read(spark, sf_dir, "embeddings")
    ends = X.ends_with(F.array(i(v % 3), i(v % 5)), F.array(F.lit(1), F.lit(1)))
    return e.select(_long("vec_id"), text(X.mask_labels(F.array(F.lit(7), F.lit(8)), x)).alias("masked"), text(X.pad(x, 7, 0)).alias("padded"), text(X.pad(x, 3, 0)).alias("cut"), text(X.valid_gold(F.array(F.lit(-1), F.lit(0), i(v % 9), F.lit(4)), F.lit(5))).alias("gold"), i(X.resolve_index(i(-(v % 11) - 1), F.lit(5))).alias("resolved"), text(X.cyclic_slice(x, i(v % 5), 4)).alias("cyclic"), X.count_at_least(x, F.lit(2)).alias("at_least"), ends.alias("ends"))


@query("""with o as (select l_orderkey, list((l_partkey % 3)::int order by l_linenumber) a, list((l_suppkey % 3)::int order by l_linenumber) b, min(l_partkey) low, max(l_partkey) high, sum(l_suppkey) % (3 * count(*)) place from lines group by 1),
p as (select *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] != b[i])), len(a) + 1) - 1 same,
 list_min(list_filter(range(1, len(a) - 1), lambda i: a[i] = a[-2] and a[i + 1] = a[-1])) two, list_min(list_filter(range(1, len(a)), lambda i: a[i] = a[-1])) one from o)
select l_orderkey::bigint l_orderkey, array_to_string(a[1:same], ',') prefix, array_to_string(list_transform(range(0, len(a), 3), lambda i: array_to_string(a[i + 1:i + 3], '+')), ',') chunks,
 array_to_string(list_sort(list_distinct(list_transform([1, 2, 3], lambda i: round_even(low + (high - low) * i / 4.0, 0)::bigint))), ',') points,
 array_to_string(case when two is not null then a[two + 2:two + 3] when one is not null then a[one + 1:one + 2] else [] end, ',') proposed, len(list_filter(range(1, len(a) + 1), lambda i: 3 * i > place))::int straddling from p""")
def sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as sequences: common prefixes, chunks, points between two ends, continuations by the longest suffix met before,
    tokens beyond a place."""
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    entry = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 3).cast("int").alias("a"), (F.col("l_suppkey") % 3).cast("int").alias("b"))))
    o = lines(spark, sf_dir).groupBy(_long("l_orderkey")).agg(entry.alias("e"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), (F.sum("l_suppkey") % (3 * F.count(F.lit(1)))).alias("place"))
    o = o.withColumn("a", F.transform("e", lambda x: x["a"])).withColumn("b", F.transform("e", lambda x: x["b"]))
    offsets = F.transform("e", lambda x, i: F.struct((3 * i).alias("start"), (3 * i + 3).alias("end")))
    chunks = F.transform(X.chunked(F.col("a"), 3), lambda c: F.array_join(c.cast("array<string>"), "+"))
    points = X.interior_points(F.col("low").cast("double"), F.col("high").cast("double"), 3).cast("array<long>")
    return o.select("l_orderkey", text(X.common_prefix(F.array("a", "b"))).alias("prefix"), F.array_join(chunks, ",").alias("chunks"), text(points).alias("points"), text(X.propose_by_ngram(F.col("a"), 1, 2, 2)).alias("proposed"), F.size(X.continuation_tokens(offsets, F.col("place"))).alias("straddling"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x != '') ws from documents),
p as (select doc_id, ws, len(ws) n, list_min(list_filter(range(1, len(ws) - 3), lambda i: ws[i] = ws[-4] and ws[i + 1] = ws[-3] and ws[i + 2] = ws[-2] and ws[i + 3] = ws[-1])) p4,
 list_min(list_filter(range(1, len(ws) - 2), lambda i: ws[i] = ws[-3] and ws[i + 1] = ws[-2] and ws[i + 2] = ws[-1])) p3, list_min(list_filter(range(1, len(ws) - 1), lambda i: ws[i] = ws[-2] and ws[i + 1] = ws[-1])) p2 from w)
select doc_id::bigint doc_id, array_to_string(case when p4 is not null then ws[p4 + 4:p4 + 8] when p3 is not null then ws[p3 + 3:p3 + 7] when p2 is not null then ws[p2 + 2:p2 + 6] else [] end, ' ') proposed from p""")
def ngram_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document would go on with if it repeated itself: five words after the first place of its last two to four."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t-\r]+", -1), lambda w: w != "")
    return read(spark, sf_dir, "documents").select(_long("doc_id"), F.array_join(X.propose_by_ngram(words, 2, 4, 5, "array<string>"), " ").alias("proposed"))


def _ints(xs):
    return xs.cast("array<int>")


@query("""with l as (select l_orderkey, l_linenumber, l_quantity / 10 q, l_linenumber % 2 c from lineitem)
select l_orderkey::bigint l_orderkey, l_linenumber::int l_linenumber, round(case when exp(q - greatest(q, 2.0)) >= 0.2 then q end, 6) kept, round(case when c > 0 then q / 2.0 - 0.1 * c - 0.5 else q end, 6) penalized, round(case when c = 1 then 0.0 else q - ln(exp(q) + exp(2.0)) end, 6)::double as prior, round(case when l_linenumber < 3 then -1e9 else q end, 4) as held from l""")
def logit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits under a least share, penalties for seen tokens, a prior's log scores (uniform or of the logits), and an end token held back."""
    line = read(spark, sf_dir, "lineitem").select(_long("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), (F.col("l_quantity") / 10).alias("q"))
    two = F.array(F.col("q").cast("double"), F.lit(2.0))
    counts = F.array((F.col("l_linenumber") % 2).cast("int"), F.lit(0))
    pen = X.penalized(two, counts, repetition=2.0, frequency=0.1, presence=0.5)
    held = X.held_back(two, F.lit(0), F.col("l_linenumber"), 3)
    prior = F.when(F.col("l_linenumber") % 2 == 1, F.get(X.prior("uniform", two), 0)).otherwise(F.get(X.prior("log_softmax", two), 0))
    return line.select("l_orderkey", "l_linenumber", F.round(F.get(X.min_p(two, 0.2), 0), 6).alias("kept"), F.round(F.get(pen, 0), 6).alias("penalized"), F.round(prior, 6).alias("prior"), F.round(F.coalesce(F.get(held, 0), F.lit(-1e9)), 4).alias("held"))


@query("""with f as (select conv_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '')[1:3] ns from conversations where turn = 0),
r as (select c.conv_id, c.turn, lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) r, list_transform(coalesce(ns, []), lambda x: lower(x)) ns from conversations c left join f using (conv_id)),
s as (select *, len(list_filter(ns, lambda x: contains(r, x))) found, len(ns) n from r)
select conv_id::bigint conv_id, turn::bigint turn, case when n = 0 or r = '' or found = 0 then 1 when found = n then 10 else 1 + round_even(8 * found / n, 0)::int end::int score from s""")
def needle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first three words of its conversation each turn repeats, as scores."""
    c = read(spark, sf_dir, "conversations")
    needles = c.where("turn = 0").select("conv_id", F.slice(T.words(F.col("text")), 1, 3).alias("needles"))
    score = A.needles_score(F.col("text"), F.coalesce("needles", F.array().cast("array<string>")))
    return c.join(needles, "conv_id", "left").select(_long("conv_id"), _long("turn"), score.cast("int").alias("score"))


@query("""with t as (select l_orderkey, list(l_linenumber order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) y from lineitem group by 1) select l_orderkey::bigint l_orderkey, round(len(list_filter(range(2, len(y) + 1), lambda i: y[i] != 3 and y[i] = y[i - 1] + 1)) / nullif(len(list_filter(range(2, len(y) + 1), lambda i: y[i] != 3)), 0), 6) accuracy from t""")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labels that the prediction one place before has met, masked labels left out."""
    g = read(spark, sf_dir, "lineitem").groupBy(_long("l_orderkey")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("y"))
    return g.select("l_orderkey", F.round(E.token_accuracy(F.transform("y", lambda x: x + 1), F.col("y"), 3), 6).alias("accuracy"))


@query("""with e as (select event_id, -value / 100 a, -(event_id % 97) / 10.0 b, event_id % 4 k, value from events)
select event_id::bigint event_id, round(case when k = 3 then value when k = 1 then a else a + b end, 6) as logprob, case k when 1 then 1 when 3 then 0 else 2 end::int n from e""")
def logprob_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log-probabilities from numbers, objects and maps in JSON, and their sum, or a sum that is given."""
    k, a, b = F.col("event_id") % 4, (-F.col("value") / 100).cast("string"), (-(F.col("event_id") % 97) / 10.0).cast("string")
    numbers = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    objects = F.concat(F.lit('[{"logprob": '), a, F.lit("}]"))
    maps = F.concat(F.lit('[{"17": {"logprob": '), a, F.lit(', "rank": 1}}, {"9": {"logprob": '), b, F.lit("}}]"))
    xs = E.token_logprobs(F.when(k == 0, numbers).when(k == 1, objects).when(k == 2, maps).otherwise("[]"))
    given = F.when(k == 3, F.col("value"))
    return read(spark, sf_dir, "events").select(_long("event_id"), F.round(E.continuation_logprob(xs, given), 6).alias("logprob"), F.size(xs).alias("n"))


@query("""select user_id::bigint user_id, count(*) n, round(avg(value), 6) reward, round(sum(value) / count(*), 6) per_token from events group by 1""")
def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of request, reward and timing, summed by user."""
    e = read(spark, sf_dir, "events").select(_long("user_id"), L.prediction_row(F.col("event_id"), F.lit(4), F.lit(1), F.col("value"), F.col("value")).alias("r")).select("user_id", "r.*")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("reward"), F.round(F.sum("seconds") / F.sum("output_tokens"), 6).alias("per_token"))


# Conversations


@query("""with c as (select conv_id, list({'r': role, 't': text} order by turn) m from conversations group by 1), k as (select conv_id, list_filter(m, lambda x: x.r = 'user') u, m, list_position(list_transform(m, lambda x: x.r), 'user') f from c)
select conv_id::bigint conv_id, len(m)::int n_turns, len(list_filter(m, lambda x: x.r = 'assistant'))::double loss, least(2, case when f > 0 then len(m) - f + 1 else 0 end)::int n_openai, array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') as chat from k""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared conversations as canonical messages (loss on the assistant's), as at most two turns from the first user turn on, and as
    chat text."""
    c = _turns(spark, sf_dir).withColumn("shared", F.transform("m", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["content"].alias("value"))))
    m = C.from_shared(F.col("shared"))
    loss = F.aggregate(m, F.lit(0.0), lambda a, x: a + x["loss_weight"])
    return c.select("conv_id", F.size(m).alias("n_turns"), loss.alias("loss"), F.size(C.openai_messages(F.col("shared"), 2)).alias("n_openai"), C.chat_text(F.col("m")).alias("chat"))


@query("""with c as (select conv_id, list(role order by turn) r from conversations group by 1)
select conv_id::bigint conv_id, array_to_string(case when conv_id % 2 = 1 then r else list_transform(list_filter(range(1, len(r) + 1), lambda i: i = 1 or i % 2 = 0 or r[i] != r[i - 1]), lambda i: r[i]) end, ',') as turns from c""")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a conversation as one: a part's first turn goes if its speaker spoke last. Parts are pairs of turns, which share a turn with
    the pair before in conversations of an odd id."""
    c = _turns(spark, sf_dir).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"))).alias("m"))
    step = F.when(F.col("conv_id") % 2 == 1, 1).otherwise(2)
    starts = F.sequence(F.lit(1), F.greatest(F.size("m") - (2 - step), F.lit(1)), step)
    return c.select("conv_id", F.array_join(F.transform(C.join_parts(F.transform(starts, lambda i: F.slice("m", i, 2))), lambda x: x["role"]), ",").alias("turns"))


@query("""with c as (select conv_id, list(text order by turn) t from conversations group by 1), x as (select conv_id, t, unnest(range(1, len(t))) i from c) select conv_id::bigint conv_id, i::int as position, t[i + 1] as turn, t[i] as previous from x""")
def turn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn after the first with the one before."""
    c = _turns(spark, sf_dir).select("conv_id", F.transform("m", lambda x: x["content"]).alias("t"))
    return readers.turn_history(c, "conv_id", "t").select("conv_id", "position", "turn", "previous")


@query("""select conv_id::bigint conv_id, coalesce(bool_or(contains(text, '. The')), false) or count(*) >= 6 as ended from conversations group by 1""")
def dialogue_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dialogue has ended, by an answer or after so many steps: sentences that begin with `The` are the answers."""
    c = _turns(spark, sf_dir).select("conv_id", F.transform("m", lambda x: F.replace(x["content"], F.lit(". The"), F.lit(".[ANSWER]"))).alias("t"))
    return c.select("conv_id", C.transition(F.col("t"), 6).alias("ended"))


@query("""select conv_id::bigint conv_id, turn::bigint turn, 'user' as role0, 'assistant' as role1, 'c' || turn as chosen, 'r' || turn as rejected, 1.0::double w from conversations where role = 'user'""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs as canonical messages: the prompt, and both answers, the loss on each answer."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    one = lambda role, t: F.struct(F.lit(role).alias("from"), t.alias("value"))
    n = F.col("turn").cast("string")
    p = C.from_pair(F.array(one("human", F.col("text"))), one("gpt", F.concat(F.lit("c"), n)), one("gpt", F.concat(F.lit("r"), n)))
    part = lambda side, i: F.get(F.get(p[side], i)["content"], 0)["value"]
    return c.select(_long("conv_id"), _long("turn"), F.get(p["chosen"], 0)["role"].alias("role0"), F.get(p["chosen"], 1)["role"].alias("role1"), part("chosen", 1).alias("chosen"), part("rejected", 1).alias("rejected"), F.get(p["rejected"], 1)["loss_weight"].alias("w"))


@query("""select conv_id::bigint conv_id, turn::bigint turn, case when role = 'user' then '' else 'f' end as tool, case when role = 'user' then null else turn end::bigint as argument from conversations""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function calls in shared conversations, read from JSON; text that isn't a call gives none."""
    c = read(spark, sf_dir, "conversations")
    raw = F.when(F.col("role") == "user", F.lit("{not json")).otherwise(F.concat(F.lit('{"name": "f", "arguments": {"x": '), F.col("turn").cast("string"), F.lit("}}")))
    call = C.tool_call(raw)
    return c.select(_long("conv_id"), _long("turn"), F.coalesce(call["name"], F.lit("")).alias("tool"), F.get_json_object(call["arguments"], "$.x").cast("long").alias("argument"))


@query("""select o_custkey::bigint o_custkey, o_orderkey::bigint question, 'yes' as answer, o_orderstatus as passage from orders union all select o_custkey, o_orderkey, 'no', o_orderpriority from orders""")
def verification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a question: its gold passage, yes, and another, no."""
    o = read(spark, sf_dir, "orders").select(_long("o_custkey"), F.col("o_orderkey").cast("long").alias("question"), F.col("o_orderstatus").alias("p"), F.col("o_orderpriority").alias("n"))
    v = C.verification_rows(o.withColumn("key", F.struct("o_custkey", "question")), "key", "p", "n")
    return v.select("key.o_custkey", "key.question", "answer", "passage")


@query("""select c_custkey::bigint c_custkey, b::int branch, case b when 0 then c_name when 1 then c_mktsegment else c_name || b end passage, b = c_custkey % 3 is_gold from customer, (select unnest([0, 1, 2]) b)""")
def ensemble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of a question, with its index and whether it is gold."""
    c = read(spark, sf_dir, "customer").select(_long("c_custkey"), F.array("c_name", "c_mktsegment", F.concat("c_name", F.lit("2"))).alias("passages"), F.array((F.col("c_custkey") % 3).cast("int"), F.lit(-1)).alias("gold"))
    return C.ensemble_rows(c, "passages", "gold", keep=["c_custkey"]).select("c_custkey", "branch", "passage", "is_gold")


@query("""select p_partkey::bigint p_partkey, 'empty_document' as none, p_brand || ':' || array_to_string(string_split(p_name, ' ')[1:2], ' ') as first_two, greatest(floor(floor(round_even(p_size * 10.0 * f, 0) / 14) * floor(round_even(p_size * 20.0 * f, 0) / 14) / 4), 1)::int tokens
from (select *, case when p_size * p_size * 200.0 > 1003520 then sqrt(1003520 / (p_size * p_size * 200.0)) when p_size * p_size * 200.0 < 3136 then sqrt(3136 / (p_size * p_size * 200.0)) else 1.0 end f from part)""")
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passages with texts cut to two words, an empty one for none, and the tokens of an image."""
    p = read(spark, sf_dir, "part")
    passages = F.array(F.struct(F.col("p_brand").alias("passage_id"), F.col("p_name").alias("text")), F.struct(F.lit("x").alias("passage_id"), F.lit("y").alias("text")))
    one = F.get(C.selected_documents(passages, 1, 2), 0)
    tokens = C.image_tokens(F.col("p_size") * 20.0, F.col("p_size") * 10.0)
    return p.select(_long("p_partkey"), F.get(C.selected_documents(passages, 0), 0)["passage_id"].alias("none"), F.concat(one["passage_id"], F.lit(":"), one["text"]).alias("first_two"), tokens.alias("tokens"))


# Orders and samples


@query("""with r as (select o_orderkey, o_orderkey % 4 q, o_orderpriority, o_orderdate from orders)
select o_orderkey::bigint o_orderkey, row_number() over (partition by q order by o_orderpriority, o_orderdate, o_orderkey)::int by_priority, row_number() over (partition by q order by o_orderdate, o_orderkey)::int by_arrival from r""")
def request_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns in which four queues serve their requests: by priority and arrival, or by arrival."""
    o = read(spark, sf_dir, "orders").select(_long("o_orderkey"), (F.col("o_orderkey") % 4).alias("q"), "o_orderpriority", "o_orderdate")
    a = C.queue_order(o, ["q"], arrival="o_orderdate", tie="o_orderkey", priority="o_orderpriority").withColumnRenamed("turn", "by_priority")
    return C.queue_order(a, ["q"], arrival="o_orderdate", tie="o_orderkey").select("o_orderkey", F.col("by_priority").cast("int").alias("by_priority"), F.col("turn").cast("int").alias("by_arrival"))


@query("""with l as (select distinct case when p_size % 7 = 0 then 'len' || p_size else p_size::varchar end as length from part) select length, row_number() over (order by try_cast(length as bigint) is null, try_cast(length as bigint), length)::int as place from l""")
def length_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a report in numeric order, names last."""
    from pyspark.sql import Window

    p = read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("len"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("length")).distinct()
    return p.withColumn("place", F.row_number().over(Window.orderBy(*C.length_order(F.col("length")))))


@query("""with o as (select o_custkey, o_orderkey, o_totalprice s, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 i from orders) select o_custkey::bigint o_custkey, o_orderkey::bigint o_orderkey, (i // 4)::int batch, row_number() over (partition by o_custkey order by s desc, i)::int as "rank" from o""")
def batched_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored in batches of four, the last one smaller, then ranked by score."""
    o = read(spark, sf_dir, "orders").groupBy(_long("o_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("e"))
    lists = o.select("o_custkey", F.transform("e", lambda x: F.struct(x["o_orderkey"].cast("long").alias("o_orderkey"), x["o_totalprice"].alias("s"))).alias("c"))
    out = R.batched_rerank(lists, "c", 4, lambda x: x["s"])
    return R.explode_ranked(out, "c", keep=["o_custkey"]).select("o_custkey", "o_orderkey", F.col("batch").cast("int").alias("batch"), F.col("rank").cast("int").alias("rank"))


@query("""with p as (select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) r from events) select user_id::bigint user_id, string_agg(event_type, ',' order by event_id) kinds from p where r = 1 group by 1""")
def deduplicated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without what they repeat, first places kept, if the option asks for it."""
    e = read(spark, sf_dir, "events").groupBy(_long("user_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("text")))).alias("c"))
    lists = R.retrieved(F.transform("c", lambda x: F.struct(x["text"].alias("text"))), deduplicate=True)
    return e.select("user_id", F.array_join(F.transform(lists, lambda x: x["text"]), ",").alias("kinds"))


@query("""with d as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () n from documents), s as (select s slot, ('0x' || left(md5('5:' || s), 13))::bigint h from range(300) r(s)), x as (select max(n) n from d)
select slot::bigint slot, doc_id::bigint doc_id from s, x join d on d.i = s.h % x.n""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 rows drawn with replacement."""
    d = readers.indexed({"d": read(spark, sf_dir, "documents").select(_long("doc_id"))}, {"d": "doc_id"})
    return C.resample(d, 300, d.count(), "row_id", 5).select("slot", "doc_id")


@query("""with h as (select o_custkey, list(o_orderkey order by o_orderkey) ids from orders group by 1),
c as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(o_custkey::varchar, ''), lambda y: ascii(y)::bigint)),
 lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) crc from h)
select o_custkey::bigint o_custkey, ids[(('0x' || left(md5('3:' || o_custkey), 13))::bigint % len(ids) + 1)::int]::bigint gold, 40 + (('0x' || left(md5('8:' || o_custkey), 13))::bigint % 21)::int as length, (crc % 7)::int as engine from c""")
def seeded_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gold id of several and a length within bounds, both by seed; and which of seven engines a key goes to."""
    o = read(spark, sf_dir, "orders").groupBy(_long("o_custkey")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("long"))).alias("ids"))
    engine = T.route(F.col("o_custkey").cast("string"), 7)
    return o.select("o_custkey", C.pick(F.col("ids"), 3, F.col("o_custkey")).alias("gold"), C.uniform_length(50, 0.2, 8, F.col("o_custkey")).alias("length"), engine.alias("engine"))


@query("""with l as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by (l_linenumber != 2)::int, md5('6:' || l_orderkey || ':' || l_linenumber), l_linenumber) r from (select distinct l_orderkey, l_linenumber from lineitem)) select l_orderkey::bigint l_orderkey, l_linenumber::int l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as index from l where r <= 3""")
def needle_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items of each example, its needle among them, in their first order."""
    line = read(spark, sf_dir, "lineitem").select(_long("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber")).distinct().withColumn("needle", F.col("l_linenumber") == 2)
    return C.with_needle(line, 3, 6, example="l_orderkey", item="l_linenumber", position="l_linenumber", is_needle="needle").select("l_orderkey", "l_linenumber", "index")


@query("""with l as (select o_custkey k, list(o_orderkey order by o_orderkey) ids from orders group by 1) select k::bigint k, len(ids)::int n from l where len(ids) >= 10 and k % 12 between 1 and 10""")
def gold_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose list is long enough and whose gold is among its first ten."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("k")).agg(F.collect_list("o_orderkey").alias("ids"))
    return C.gold_pool(o.withColumn("gold_rank", F.col("k") % 12), "ids", "gold_rank", 10).select("k", F.size("ids").alias("n"))


@query("""with i as (select s id, ('0x' || left(md5('9:' || s), 13))::bigint % 36 j from range(100) r(s)) select id::bigint id, id < 40 as has_needle, case when id < 40 then j // 4 else -1 end::int as index, case when id < 40 then j % 4 // 2 else -1 end::int as row, case when id < 40 then j % 4 % 2 else -1 end::int as col from i""")
def needle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 examples of nine images of two by two cells, 40 of them with a needle in a seeded cell."""
    return Q.needle_cells(spark, 100, 40, 9, 2, 9)


@query("""select count(*) n, count(distinct (id, image)) n_different, count(distinct id) n_stitches, count(distinct cell) n_cells, true as unused from (select s id, c cell, s * 4 + i image from range(50) r(s), (values ('0_0', 0), ('0_1', 1), ('1_0', 2), ('1_1', 3)) t(c, i))""")
def stitched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 stitches of four different images each; and images that no stitch has."""
    from functools import reduce

    images = readers.indexed({"c": read(spark, sf_dir, "customer").select(_long("c_custkey"))}, {"c": "c_custkey"}).select("row_id", F.col("c_custkey").alias("image"))
    s = Q.stitched(spark, 50, images, "image", 2, 4)
    free = M.unfinished(images, s.select("image").distinct(), "image")
    clash = free.join(s.select("image").distinct(), "image").agg(F.count(F.lit(1)).alias("x"))
    counts = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id", "image").alias("n_different"), F.count_distinct("id").alias("n_stitches"), F.count_distinct("cell").alias("n_cells"))
    return reduce(lambda a, b: a.join(b), [counts, clash]).select("n", "n_different", "n_stitches", "n_cells", (F.col("x") == 0).alias("unused"))


@query("""select doc_id::bigint doc_id, place from (select doc_id, row_number() over (order by md5('1:' || doc_id), doc_id) - 1 as place from documents)""")
def shuffled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded order of a shuffle, as places."""
    d = read(spark, sf_dir, "documents").select(_long("doc_id"))
    return M.shuffled_places(d, "doc_id", 1)


@query("""with d as (select doc_id, row_number() over (order by doc_id) - 1 i from documents) select doc_id::bigint doc_id, case when i < 30 then 'validation' else 'train' end split from d""")
def taken_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's first rows as validation, the rest as training rows."""
    d = read(spark, sf_dir, "documents").select(_long("doc_id"))
    first, rest = M.take_skip(d, 30, "doc_id")
    return first.withColumn("split", F.lit("validation")).unionByName(rest.withColumn("split", F.lit("train")))


@query("""with r as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () n from documents), x as (select max(n) n from r), s as (select unnest(range(0, ((select n from x) + 63) // 64 * 64)) p) select (p // 64)::bigint batch, (p % 64)::bigint as place, doc_id::bigint doc_id from s, x join r on r.i = s.p % x.n""")
def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 rows; the last one is filled by starting again."""
    d = read(spark, sf_dir, "documents").select(_long("doc_id"))
    return M.full_batches(d, 64, "doc_id").select("batch", "place", "doc_id")


@query("""select (doc_id * 2 + 7)::bigint doc_id, array_to_string(list_concat([doc_id, doc_id + 1], list_resize([]::bigint[], 4, 0)), ',') ids, '-100,' || doc_id || ',-100,-100,-100,-100' as labels, '0,1,0,0,0,0' as places, '1,1,0,0,0,0' as numbers from documents""")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knapsacks as padded rows: ids, labels, places and sequence numbers."""
    i = F.col("doc_id").cast("int")
    d = read(spark, sf_dir, "documents").select((F.col("doc_id").cast("long") * 2 + 7).alias("g"), _long("doc_id"), F.array(i, i + 1).alias("x"), F.array(F.lit(-100), i).alias("y"))
    p = M.packed_rows(d, ["g"], "x", "y", "doc_id", 5)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return p.select(F.col("g").alias("doc_id"), text("input_ids").alias("ids"), text("labels").alias("labels"), text("position_ids").alias("places"), text("sequence_ids").alias("numbers"))


@query("""with c as (select conv_id, list(lower(text) order by turn) t from conversations group by 1),
r as (select *, list_position(list_transform(t[2:], lambda x: contains(x, left(t[1], 6)) or contains(x, left(t[1], 3) || ' ')), true) r from c)
select conv_id::bigint conv_id, case when r > 0 and r < 4 then r when len(t) - 1 >= 4 then 4 else 10 end::int gold_rank from r""")
def capped_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first later turn that holds one of two answers out of the first turn, with the caps of the pipeline reports."""
    c = _turns(spark, sf_dir).select("conv_id", F.transform("m", lambda x: x["content"]).alias("t"))
    first, rest = F.get("t", 0), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    rank = R.first_text_hit(rest, F.array(F.left(first, F.lit(6)), F.concat(F.left(first, F.lit(3)), F.lit(" "))))
    return c.select("conv_id", R.capped_rank(rank, F.size(rest), cap=4, missing=10).cast("int").alias("gold_rank"))


@query("""with d as (select conv_id, turn, length(text) n from conversations), c as (select a.conv_id, a.turn, avg(1.0 / (1 + abs(a.n - b.n))) s from d a join d b on a.conv_id = b.conv_id and a.turn != b.turn group by 1, 2)
select conv_id::bigint conv_id, arg_max(turn, (round(s, 9), -turn))::bigint turn, round(max(s), 6) mean_similarity from c group by 1""")
def minimum_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the few samples of each question the one most like the others, by their lengths: a conversation's turns stand for samples."""
    d = read(spark, sf_dir, "conversations").select(_long("conv_id"), F.col("turn").alias("sample"), F.struct("turn", F.length("text").alias("n")).alias("c"))
    out = E.minimum_risk(d, "conv_id", "c", lambda a, b: 1.0 / (1 + F.abs(a["n"] - b["n"])))
    return out.select("conv_id", F.col("c.turn").cast("long").alias("turn"), F.round("mean_similarity", 6).alias("mean_similarity"))


@query("""with w as (select conv_id q, turn i, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x != '') ws from conversations),
g as (select q, i, n, array_to_string(ws[p:p + n - 1], ' ') g, count(*) c from (select q, i, ws, n, unnest(range(1, len(ws) - n + 2)) p from w, (select unnest([1, 2, 3, 4]) n)) group by all),
m as (select a.q, a.i, sum(least(a.c, b.c)) filter (a.n = 1) m1, sum(least(a.c, b.c)) filter (a.n = 2) m2, sum(least(a.c, b.c)) filter (a.n = 3) m3, sum(least(a.c, b.c)) filter (a.n = 4) m4 from g a join g b on a.q = b.q and a.n = b.n and a.g = b.g and a.i != b.i group by 1, 2),
l as (select q, i, len(ws) l, count(*) over (partition by q) - 1 k, sum(len(ws)) over (partition by q) - len(ws) r from w),
s as (select q, i, case when coalesce(m1, 0) = 0 then 0 else least(1, exp(1 - r / (k * l))) * exp((ln(m1 / (k * l)) + ln((coalesce(m2, 0) + 1) / (k * greatest(l - 1, 0) + 1)) + ln((coalesce(m3, 0) + 1) / (k * greatest(l - 2, 0) + 1)) + ln((coalesce(m4, 0) + 1) / (k * greatest(l - 3, 0) + 1))) / 4) end b from l left join m using (q, i))
select q::bigint conv_id, arg_min(i, (-round(b, 9), i))::bigint turn, round(max(b), 6) bleu from s group by 1""")
def minimum_risk_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the turns of each conversation, as samples of one answer, the one of least risk under BLEU."""
    c = read(spark, sf_dir, "conversations").select(_long("conv_id"), _long("turn"), "text")
    return E.minimum_risk_bleu(c, "conv_id", "turn", "text").withColumn("bleu", F.round("bleu", 6))


@query("""with o as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) select o_custkey::bigint o_custkey, o_orderkey::bigint o_orderkey, r::int as "rank" from o where r <= 3 and o_orderstatus != 'F'""")
def static_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline declared as a list of named steps: retrieve the best three, number them, keep what is verified."""
    o = read(spark, sf_dir, "orders").select(_long("o_custkey"), _long("o_orderkey"), "o_totalprice", "o_orderstatus")
    plan = [("retrieve", {"by": "o_custkey", "score": "o_totalprice", "tie": "o_orderkey", "ret_topk": 3}), ("verify", {"condition": "o_orderstatus != 'F'"}), ("project", {"columns": ["o_custkey", "o_orderkey", "rank"]})]
    return registry.run_plan(o, plan).withColumn("rank", F.col("rank").cast("int"))


# Encodings and scores


@query("""with c as (select c_custkey k, list_transform(range(0, c_custkey % 20 + 1), lambda i: 100 + i) p, list_transform(range(0, c_custkey % 7 + 1), lambda i: 200 + i) a, list_transform(range(0, c_custkey % 11 + 1), lambda i: 300 + i) b from customer),
n as (select *, len(p) s, greatest(len(a), len(b)) t from c), m as (select *, least(case when t * 2 < 16 then 16 when s * 2 < 16 then 16 - s else floor(16 * (t / (s + t)))::int end, t) nt from n), l as (select *, least(greatest(16 - nt, 0), s) ns from m)
select k::bigint c_custkey, array_to_string(list_concat(p[1:ns], a[1:nt]), ',') chosen_ids, array_to_string(list_concat(list_transform(range(0, ns), lambda i: -100), b[1:nt]), ',') rejected_labels, k % 2 = 0 as tag,
 array_to_string(list_concat(list_transform(p, lambda i: -100), a), ',') rendered_labels, len(a)::double as weight from l""")
def pair_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and labels of preference pairs and of tagged answers under a cutoff of 16, and of messages by their loss weights."""
    k = F.col("c_custkey")
    seq = lambda n, start: F.transform(F.sequence(F.lit(0), (k % n).cast("int")), lambda i: i + start)
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    c = read(spark, sf_dir, "customer").select(_long("c_custkey"), seq(20, 100).alias("p"), seq(7, 200).alias("a"), seq(11, 300).alias("b"))
    pair = X.pair_encoding(F.col("p"), F.col("a"), F.col("b"), 16)
    tagged = X.binary_encoding(F.col("p"), F.col("a"), k % 2 == 0, 16)
    chat = X.rendered(F.array(F.struct(F.col("p").alias("ids"), F.lit(0.0).alias("loss_weight")), F.struct(F.col("a").alias("ids"), F.lit(1.0).alias("loss_weight"))))
    weight = F.aggregate(chat["loss_weights"], F.lit(0.0), lambda x, y: x + y)
    return c.select("c_custkey", text(pair["chosen_ids"]).alias("chosen_ids"), text(pair["rejected_labels"]).alias("rejected_labels"), tagged["tag"].alias("tag"), text(chat["labels"]).alias("rendered_labels"), weight.alias("weight"))


@query("""select c_custkey::bigint c_custkey, case when c_custkey % 2 = 0 then 0.5 else length(c_name) + c_nationkey end::double score from customer""")
def pluggable_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any Python scorer as a column; where it fails the score is the stated one."""

    def scorer(question: str, references: list[str], candidate: str) -> float:
        if int(question) % 2 == 0:
            raise ValueError("no score")
        return len(candidate) + float(references[0])

    c = read(spark, sf_dir, "customer")
    score = S.pluggable(scorer, on_error=0.5)(F.col("c_custkey").cast("string"), F.array(F.col("c_nationkey").cast("string")), F.col("c_name"))
    return c.select(_long("c_custkey"), score.alias("score"))


@query("""with t as (select conv_id, max(text) filter (where turn = 1) p, max(text) filter (where turn = 0) r from conversations group by 1),
w as (select conv_id, s, list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y != '') ws from (select conv_id, 'p' s, p x from t where p is not null and r is not null union all select conv_id, 'r', r from t where p is not null and r is not null)),
g as (select conv_id, s, n, array_to_string(ws[i:i + n - 1], ' ') gram from (select *, unnest(range(1, len(ws) - n + 2)) i from (select *, unnest([1, 2, 3, 4]) n from w) where len(ws) >= n)),
k as (select conv_id, s, n, gram, count(*) c from g group by 1, 2, 3, 4), m as (select p.n, sum(least(p.c, r.c)) m from k p join k r on p.s = 'p' and r.s = 'r' and p.conv_id = r.conv_id and p.n = r.n and p.gram = r.gram group by 1),
t4 as (select n, sum(c) t from k where s = 'p' group by 1), l as (select sum(len(ws)) filter (where s = 'p') pl, sum(len(ws)) filter (where s = 'r') rl from w),
x as (select count(*) n, avg(ln(m.m / t4.t)) a from t4 join m using (n))
select round(case when n < 4 then 0.0 else 100 * exp(a) * case when pl < rl then exp(1 - rl / pl) else 1.0 end end, 4) bleu from x, l""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of all conversations' second turns against their first."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate("rp")])
    return S.corpus_bleu(c.where("p is not null and r is not null"), "p", "r").select(F.round("bleu", 4).alias("bleu"))


@query("""with q as (select event_id, event_type, value, user_id, row_number() over (order by value desc, user_id desc, event_id) r from events) select event_id::bigint event_id, 'worst' as category from q where r <= 20""")
def worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by several columns of evidence."""
    e = read(spark, sf_dir, "events").select(_long("event_id"), "value", "user_id")
    return N.top_n(e, 20, F.col("value").desc(), F.col("user_id").desc(), F.col("event_id"), category="worst").select("event_id", "category")


@query("""with c as (select c_custkey, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1) select 'orders' as "column", min(n) filter (where n > 0)::bigint least, round(avg(n) filter (where n > 0), 6) mean, max(n) filter (where n > 0)::bigint most, count(*) filter (where n = 0) n_missing from c
union all select 'pair', 2, 2.0, 2, 0""")
def list_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of list columns, and how often a list is missing."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("orders"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("pair")).join(o, "c_custkey", "left")
    p = N.profile_lists(c, ["orders", "pair"])
    return p.select("column", _long("least"), F.round("mean", 6).alias("mean"), _long("most"), "n_missing")


@query("""select p_partkey::bigint p_partkey, p_name as passage_content from part""")
def strict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage texts for ids that must all be there."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("passage_id"), F.col("p_name").alias("passage_content"))
    return R.attach_text(p.select("passage_id"), p, strict=True).select(F.col("passage_id").alias("p_partkey"), "passage_content")


@query("""with t as (select conv_id, max(text) filter (where turn = 1) p, max(text) filter (where turn = 0) r from conversations group by 1),
w as (select conv_id, s, list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y != '') ws from (select conv_id, 'p' s, p x from t where p is not null and r is not null union all select conv_id, 'r', r from t where p is not null and r is not null)),
g as (select conv_id, s, n, array_to_string(ws[i:i + n - 1], ' ') gram from (select *, unnest(range(1, len(ws) - n + 2)) i from (select *, unnest([1, 2]) n from w) where len(ws) >= n)),
k as (select conv_id, s, n, gram, count(*) c from g group by 1, 2, 3, 4), m as (select p.conv_id, p.n, sum(least(p.c, r.c)) m from k p join k r on p.s = 'p' and r.s = 'r' and p.conv_id = r.conv_id and p.n = r.n and p.gram = r.gram group by 1, 2),
a as (select conv_id, n, sum(c) c from k group by 1, 2), f as (select c.conv_id, x.n, coalesce(2.0 * m.m / a.c, 0.0) f from (select distinct conv_id from w) c, (select unnest([1, 2]) n) x left join m on m.conv_id = c.conv_id and m.n = x.n left join a on a.conv_id = c.conv_id and a.n = x.n)
select 'rouge' || n as measure, round(avg(f), 6) as value, count(*) n from f group by f.n""")
def overlap_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE of all conversations' second turns against their first, by the name of the measure."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate("rp")])
    rows = c.where("p is not null and r is not null").select(S.rouge(T.words(F.col("p")), T.words(F.col("r"))).alias("s")).select("s.rouge1", "s.rouge2")
    return rows.unpivot([], ["rouge1", "rouge2"], "measure", "value").groupBy("measure").agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))
