"""Queries over annotations, filters, joins and aggregates of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base as B
from ..functions import text as T
from ..operators import analytics as N
from ..operators import annotations as Q
from ..operators import curation as C
from ..operators import ensemble as E
from ..operators import mixing as M
from ..operators import retrieval as R
from ..operators import telemetry as L
from ..sources import readers
from .base import lines, query, read

# Annotations: events as annotated questions of their users' images.

_ANN = """with a as (select event_id question_id, user_id image_id, event_type question_type, ['yes/no', 'number', 'other'][(event_id % 3 + 1)::int] answer_type, event_id as position from events)
"""


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("yes/no"), F.lit("number"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    answers = F.transform(F.array(F.lit(0), F.lit(1), F.lit(0)), lambda k, i: F.struct(k.alias("answer_id"), F.concat("event_type", F.lit("-"), i.cast("string")).alias("answer")))
    return e.select(F.col("event_id").alias("question_id"), F.col("user_id").alias("image_id"), F.col("event_type").alias("question_type"), kind.alias("answer_type"), answers.alias("answers"), F.col("event_id").alias("position"))


@query(_ANN + """, i as (select unnest([3, 1, 3]) image_id, generate_subscripts([3, 1, 3], 1) - 1 listed)
select 'images' as kind, question_id::bigint as id, listed::bigint listed from a join i using (image_id) where answer_type in ('number', 'other')
union all select 'types', question_id, 0 from a where question_type in ('click') and answer_type = 'yes/no'
union all select 'all', question_id, 0 from a
union all select 'image', image_id, l from a join (values (7, 0), (2, 1), (7, 2)) t(q, l) on question_id = q
union all select 'loaded', question_id, l from a join (values (5, 0), (9, 1)) t(q, l) on question_id = q""")
def annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by images (one listed twice) and types, without a filter, images of questions, and questions loaded by id."""
    a = _annotations(spark, sf_dir)
    tag = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"), "listed")
    out = tag(Q.question_ids(a, [3, 1, 3], answer_types=["number", "other"]), "images", "question_id")
    out = out.unionByName(tag(Q.question_ids(a, question_types="click", answer_types=["yes/no"]), "types", "question_id")).unionByName(tag(Q.question_ids(a), "all", "question_id"))
    return out.unionByName(tag(Q.image_ids(a, [7, 2, 7]), "image", "image_id")).unionByName(tag(Q.loaded(a, [5, 9]), "loaded", "question_id"))


@query("""select user_id::bigint image_id, count(*) n, string_agg(event_id::varchar, ',' order by event_id) question_ids from events group by 1""")
def annotation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.by_image(_annotations(spark, sf_dir))
    return a.select(F.col("image_id").cast("long").alias("image_id"), F.size("question_ids").cast("long").alias("n"), F.array_join(F.col("question_ids").cast("array<string>"), ",").alias("question_ids"))


@query("""select event_id::bigint question_id, user_id::bigint image_id, 'Q' || c_name as question, event_type || '-2|' || event_type || '-1' as answers from events join customer on event_id = c_custkey""")
def flat_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their question's text (customers' names, the last of two) and the answers as a map: of equal ids the last."""
    c = read(spark, sf_dir, "customer")
    q = c.select(F.col("c_custkey").alias("question_id"), F.explode(F.array(F.struct(F.concat(F.lit("old"), "c_name").alias("question"), F.lit(0).alias("position")), F.struct(F.concat(F.lit("Q"), "c_name").alias("question"), F.lit(1).alias("position")))).alias("x")).select("question_id", "x.*")
    out = Q.flat_qa(_annotations(spark, sf_dir), q)
    answers = F.concat_ws("|", F.try_element_at("answers", F.lit(0)), F.try_element_at("answers", F.lit(1)))
    return out.select(F.col("question_id").cast("long").alias("question_id"), F.col("image_id").cast("long").alias("image_id"), "question", answers.alias("answers"))


# Filters and projections


@query("""select doc_id::bigint question_id, 'data/img/' || lang || '.jpg' as img_path, n_chars::bigint length from documents where source in (select min(source) from documents union all select max(source) from documents)""")
def kept_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a mode (those that are there), full image paths, renamed, rows of a fixed set of sources."""
    d = read(spark, sf_dir, "documents").withColumn("img_path", F.concat("lang", F.lit(".jpg")))
    ends = d.agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    kept = C.keep_columns(C.optional_in(d, source=list(ends), lang=[]), ["doc_id", "img_path", "n_chars", "absent"])
    return readers.questions(kept.select(F.col("doc_id").cast("long").alias("question_id"), "img_path", F.col("n_chars").cast("long").alias("length")), "data/img/")


@query("""with s as (select doc_id, n_chars score from documents) select 'below' as side, count(*) n, round(100.0 * count(*) / (select count(*) from s), 6) percent, round(avg(score), 4) mean_score, min(score)::bigint worst from s where score < 900
union all select 'rest', count(*), round(100.0 * count(*) / (select count(*) from s), 6), round(avg(score), 4), min(score) from s where score >= 900 union all select 'all', count(*), 100.0, round(avg(score), 4), min(score) from s""")
def threshold_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a threshold and the others, with counts, shares and means of both and of the whole."""
    out = N.threshold_report(read(spark, sf_dir, "documents"), "n_chars", 900)
    return out.select("side", "n", F.round("percent", 6).alias("percent"), F.round("mean_score", 4).alias("mean_score"), F.col("worst").cast("long").alias("worst"))


@query("""with t as (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x != '')) n from documents)
select doc_id::bigint doc_id, n::bigint n_tokens, (select count(*) filter (where n > 200) from t) n_dropped, (select round(100.0 * count(*) filter (where n > 200) / count(*), 6) from t) percent_dropped from t where n <= 200""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most 200 words, with how many went and their percentage."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), T.count_words(F.col("text")).cast("long").alias("n_tokens"))
    kept, report = C.within_budget(d, "n_tokens", 200)
    return kept.join(F.broadcast(report.select("n_dropped", F.round("percent_dropped", 6).alias("percent_dropped"))))


@query("""with r as (select c_custkey, case when c_custkey % 5 = 0 then 'missing_question' when c_custkey % 3 = 0 then 'missing_answer' when c_acctbal < 0 then 'gold_not_found' else 'kept' end reason from customer) select reason, count(*) n from r group by 1""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows are left out: the first reason that holds, counted."""
    k = F.col("c_custkey")
    reason = C.skip_reason((k % 5 == 0, "missing_question"), (k % 3 == 0, "missing_answer"), (F.col("c_acctbal") < 0, "gold_not_found"))
    return read(spark, sf_dir, "customer").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id::bigint event_id, coalesce(nullif(nullif(value, 0), 0.0), event_id) as throughput, (select count(*) from events where user_id % 7 = 0) n_skipped from events where user_id % 7 != 0""")
def required_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that lack a metric go and are counted; of several names for one the first that has a number other than zero counts."""
    e = read(spark, sf_dir, "events").withColumn("metric", F.when(F.col("user_id") % 7 != 0, F.col("value")))
    value = F.when(F.col("metric").isNotNull(), B.first_number(F.col("metric").cast("string"), F.col("event_id").cast("string"), zero_is_missing=True))
    kept, skipped = C.with_metric(e.select(F.col("event_id").cast("long").alias("event_id"), value.alias("throughput")), "throughput")
    return kept.join(F.broadcast(skipped))


@query("""select s_suppkey::bigint s_suppkey, coalesce(nullif(trim(case when s_suppkey % 2 = 0 then '  ' else s_name end), ''), trim(s_suppkey || ' b')) label, case when s_suppkey % 3 = 0 then 'a b' else 'a' end joined,
 coalesce(nullif(s_nationkey::double, 0), nullif((s_suppkey % 4)::double, 0), 9.0) users, case when s_suppkey % 4 = 0 then (case when s_nationkey = 0 then 1 else s_nationkey end) * 2.0 else (s_suppkey % 4)::double end devices from supplier""")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field with text, a list as joined text, users of a run (configured, rate, peak) and its devices (given, or the product
    of its parallel sizes)."""
    s = read(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    blank = F.when(k % 2 == 0, F.lit("  ")).otherwise(F.col("s_name"))
    listed = T.joined_text(F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return s.select(k.cast("long").alias("s_suppkey"), B.first_text(blank, F.concat(k.cast("string"), F.lit(" b"))).alias("label"), listed.alias("joined"), B.user_count(n, (k % 4).cast("string"), F.lit("9")).alias("users"), B.device_count((k % 4).cast("string"), n, F.lit(None).cast("string"), F.lit("2")).alias("devices"))


@query("""with i as (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1) select c_custkey::bigint c_custkey, n::int as had, 0 as n_images, (select count(*) from i where n > 0) n_modified from i""")
def cleared_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with some orders as images, which are taken away, and how many rows that changes."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("images"))
    c = read(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    c = c.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.coalesce("images", F.array().cast("array<string>")).alias("images"))
    kept, report = C.without_images(c.withColumn("had", F.size("images")))
    return kept.select("c_custkey", "had", F.size("images").alias("n_images")).join(F.broadcast(report))


@query("""select p_partkey::bigint p_partkey, 'Q: ' || p_name || ' E: [EVIDENCE]<D>Title: ' || p_brand || chr(9) || 'Content: ' || p_type || '</D>' || chr(10) as prompt, '[Chunk 1]' || chr(10) || p_name || chr(10) || chr(10) || '[Chunk 2]' || chr(10) || p_type as chunks,
 'a ' || p_brand || ' <<QUESTION>>' as once from part""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts filled from a template with a list of passages as evidence, in one call; numbered chunks; a mark that is filled once."""
    p = read(spark, sf_dir, "part").withColumn("passages", F.array(F.struct(F.col("p_brand").alias("passage_id"), F.col("p_type").alias("text"))))
    out = C.with_prompt(p, "Q: <<QUESTION>> E: <<EVIDENCE>>", question="p_name", passages="passages", start="<D>", end="</D>")
    once = T.fill("a <<QUESTION>> <<QUESTION>>", True, question=F.col("p_brand"))
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "prompt", T.numbered_chunks(F.array("p_name", "p_type")).alias("chunks"), once.alias("once"))


_CHAT = """with e as (select conv_id, turn, 'img/' || conv_id || '.jpg' img_path, text as prompt, 'c' || turn chosen, 'r' || turn rejected from conversations where role = 'user')
"""


@query(_CHAT + """select conv_id::bigint conv_id, turn::bigint turn, 'sft' as mode, to_json({'messages': [{'content': '<image> ' || prompt, 'role': 'user'}, {'content': '[ANSWER] ' || chosen, 'role': 'assistant'}], 'images': [img_path]})::varchar as "row" from e
union all select conv_id, turn, 'dpo', to_json({'conversations': [{'from': 'human', 'value': '<image> ' || prompt}], 'chosen': {'from': 'gpt', 'value': chosen}, 'rejected': {'from': 'gpt', 'value': rejected}, 'images': [img_path]})::varchar from e""")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in the shared formats of both modes, as JSON."""
    e = _examples(spark, sf_dir)
    out = [C.exported(C.mode_rows(e, m), m).select("conv_id", "turn", F.lit(m).alias("mode"), "row") for m in ("sft", "dpo")]
    return out[0].unionByName(out[1])


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.col("turn").cast("string")
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("img_path"), F.col("text").alias("prompt"), F.concat(F.lit("c"), n).alias("chosen"), F.concat(F.lit("r"), n).alias("rejected"), F.array(F.col("turn").cast("int")).alias("gt_evidence_labels"))


@query(_CHAT + """select conv_id::bigint conv_id, turn::bigint turn, 'sft' as mode, prompt as answer_input, chosen as answer_target, null::varchar as rejected_target, null::int as label from e
union all select conv_id, turn, 'dpo', prompt, chosen, rejected, null from e union all select conv_id, turn, 'attn_sft', prompt, chosen, null, turn from e""")
def mode_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that each training mode reads."""
    e, out = _examples(spark, sf_dir), None
    for m in ("sft", "dpo", "attn_sft"):
        r = C.mode_rows(e, m)
        has = lambda c, kind, r=r: F.col(c).cast(kind) if c in r.columns else F.lit(None).cast(kind)
        target = "chosen_answer_target" if m == "dpo" else "answer_target"
        label = F.get("gt_evidence_labels", 0) if m == "attn_sft" else F.lit(None).cast("int")
        r = r.select("conv_id", "turn", F.lit(m).alias("mode"), "answer_input", F.col(target).alias("answer_target"), has("rejected_answer_target", "string").alias("rejected_target"), label.alias("label"))
        out = r if out is None else out.unionByName(r)
    return out


@query("""select c_custkey::bigint c_custkey, case c_custkey % 4 when 3 then 'none' else c_name end as found, case when c_custkey % 4 = 1 then c_mktsegment end as nested from customer""")
def key_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters found under any spelling of their name, nested ones by their first part: each customer has a map of its own."""
    k = F.col("c_custkey") % 4
    plain = F.when(k == 0, "max-len").when(k == 1, "max_len").when(k == 2, "max-len").otherwise("maxlen")
    nested = F.when(k == 1, "max_len.a-b").otherwise("max_len.a_b")
    m = F.create_map(plain, F.col("c_name"), nested, F.col("c_mktsegment"))
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.coalesce(T.parameter(m, "max_len"), F.lit("none")).alias("found"), T.parameter(m, "max-len.a-b").alias("nested"))


@query("""with g as (select conv_id, count(*) filter (where role = 'user') u, count(*) filter (where role = 'assistant') a from conversations group by 1) select conv_id::bigint conv_id, u % 2 = 1 and a = 1 sft, u % 2 = 1 and a >= 2 pairs, u % 2 = 1 and a = 1 and u >= 1 ensemble from g""")
def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that each kind of training takes: an odd number of prompt turns, one response or several, passages for ensembles."""
    g = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(*[F.collect_list(F.when(F.col("role") == r, F.col("turn"))).alias(r) for r in ("user", "assistant")])
    p, r = F.col("user"), F.col("assistant")
    return g.select("conv_id", C.well_formed(p, r).alias("sft"), C.well_formed(p, r, pairs=True).alias("pairs"), C.well_formed(p, r, passages=p).alias("ensemble"))


# Joins


@query("""with a as (select o_custkey, count(*) n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) pages from orders where o_orderstatus = 'P' group by 1)
select c_custkey::bigint c_custkey, coalesce(pages, '') pages, coalesce(n, 0)::int gt_count, case when n = 1 then '1_gt' when n >= 2 then 'multi_gt' else '0_gt' end gt_group from customer left join a on c_custkey = o_custkey""")
def evidence_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their evidence pages, an empty list where there are none, and the group that follows."""
    out = _evidence(spark, sf_dir)
    return out.select("c_custkey", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "gt_count", "gt_group")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").cast("long").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("pages"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", "c_nationkey")
    return Q.with_evidence(c, o, "c_custkey")


@query("""with a as (select o_custkey, count(*) n from orders where o_orderstatus = 'P' group by 1), g as (select *, case when n = 1 then '1_gt' when n >= 2 then 'multi_gt' else '0_gt' end gt_group from customer left join a on c_custkey = o_custkey)
select gt_group, count(*) n, round(avg(c_acctbal), 4) mean_score, round(avg(n), 6) mean_success from g where gt_group != '0_gt' group by 1
union all select 'multi_gt_errors', count(*), round(avg(c_acctbal), 4), round(avg(n), 6) from g where gt_group = 'multi_gt' and c_acctbal < 1000""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics that are there by evidence group, and of the errors among rows of several gold pages."""
    rows = _evidence(spark, sf_dir).where("gt_group != '0_gt'")
    out = N.group_means(rows, "gt_group", {"mean_score": "c_acctbal", "mean_success": "gt_count", "mean_absent": "absent"})
    errors = N.group_means(rows.where("gt_group = 'multi_gt' and c_acctbal < 1000").withColumn("gt_group", F.lit("multi_gt_errors")), "gt_group", {"mean_score": "c_acctbal", "mean_success": "gt_count"})
    return out.unionByName(errors).select("gt_group", "n", F.round("mean_score", 4).alias("mean_score"), F.round("mean_success", 6).alias("mean_success"))


@query("""with q as (select o_orderkey, list(l_partkey order by l_linenumber, l_partkey) ids from orders join (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) on o_orderkey = l_orderkey group by 1),
x as (select o_orderkey, unnest(ids) pid, generate_subscripts(ids, 1) i from q), m as (select o_orderkey, string_agg(p_partkey || ':' || p_brand, ',' order by i) d from x join part on pid = p_partkey and p_partkey % 3 != 0 group by 1)
select q.o_orderkey::bigint question_id, coalesce(d, '') documents from q left join m using (o_orderkey)""")
def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their gold documents in order; ids that the passages lack are left out."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    q = line.groupBy(F.col("l_orderkey").cast("long").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("pos_item_ids"))
    q = q.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("question_id")), "question_id", "left_semi")
    p = read(spark, sf_dir, "part").where("p_partkey % 3 != 0").select(F.col("p_partkey").cast("string").alias("passage_id"), F.col("p_brand").alias("passage_content"))
    out = Q.gold_documents(q, p)
    return out.select("question_id", F.array_join(F.transform("documents", lambda d: F.concat(d["id"], F.lit(":"), d["content"])), ",").alias("documents"))


@query("""with r as (select doc_id, quality from labels where doc_id % 2 = 0) select round(avg(case when (n_chars > 800)::int = quality then 1.0 else 0.0 end), 6) mean_score, count(*) n_scored, round(count(*) / (select count(*) from documents), 6) coverage from documents join r using (doc_id)""")
def judged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a reference, scored; the mean score and how many of all have one."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("guess"))
    scored = Q.scored_pairs(d, read(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", "quality"), "doc_id", (F.col("guess") == F.col("quality")).cast("double"))
    out = Q.judge_report(scored, d.count())
    return out.select(F.round("mean_score", 6).alias("mean_score"), "n_scored", F.round("coverage", 6).alias("coverage"))


@query("""select o_orderkey::bigint o_orderkey, o_totalprice, n::bigint n_lines from orders join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey""")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their annotations, where both must have the same ids."""
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")
    return Q.enriched(o.join(n, "o_orderkey", "left_semi"), n.join(o, "o_orderkey", "left_semi"), "o_orderkey")


@query("""select p_brand || '_' || p_size as file_name, arg_min(p_name, p_partkey) caption from part where p_partkey % 4 != 0 group by 1""")
def first_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image ids to file names to first captions; captions of unknown images are left out."""
    p = read(spark, sf_dir, "part")
    images = p.where("p_partkey % 4 != 0").select(F.col("p_partkey").alias("id"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("file_name"))
    return Q.captions(images, p.select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("caption"), F.col("p_partkey").alias("position")))


@query("""with c as (select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2) select l_orderkey || '_' || l_linenumber as chunk_id, l_orderkey::varchar as base, count(*) over (partition by l_orderkey) n_siblings, row_number() over (partition by l_orderkey order by l_linenumber)::int as place from c""")
def chunk_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document, its chunks' number, and their place in the natural order: by the number at the end of the id."""
    c = read(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id")).distinct()
    out = Q.siblings(c, T.base_document_id(F.col("chunk_id")))
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy(*C.natural_order(F.col("chunk_id")))))


@query("""with c as (select c_custkey, [c_name, c_mktsegment, c_name || c_mktsegment] chunks, case c_custkey % 4 when 0 then ' ' || c_mktsegment || ' ' when 1 then c_name when 2 then 'nowhere' else ' ' end needle from customer)
select c_custkey::bigint c_custkey, case when trim(needle) = '' then -1 else coalesce(list_position(list_transform(chunks, lambda x: contains(x, trim(needle))), true), 0) - 1 end::int as chunk from c""")
def needle_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk that holds a needle, -1 if none does."""
    k = F.col("c_custkey") % 4
    needle = F.when(k == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).when(k == 1, F.col("c_name")).when(k == 2, "nowhere").otherwise(" ")
    chunk = Q.first_chunk_with(F.array("c_name", "c_mktsegment", F.concat("c_name", "c_mktsegment")), needle)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), chunk.cast("int").alias("chunk"))


@query("""select 'one' as shape, 'Q' as q, c_name as d from customer union all select 'many', c_mktsegment, c_name from customer""")
def score_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and documents that a scorer sees together: one with all, or each with its own."""
    c = read(spark, sf_dir, "customer")
    d = c.select("c_custkey", F.col("c_name").alias("d"))
    one = Q.score_pairs(spark.createDataFrame([(0, "Q")], "c_custkey long, q string"), d, "c_custkey").select(F.lit("one").alias("shape"), "q", "d")
    return one.unionByName(Q.score_pairs(c.select("c_custkey", F.col("c_mktsegment").alias("q")), d, "c_custkey").select(F.lit("many").alias("shape"), "q", "d"))


@query("""with o as (select l_orderkey, list(l_partkey % 7 order by l_linenumber) ids, list_filter(list(l_suppkey % 7 order by l_linenumber), lambda x: x < 3) gold from lines group by 1)
select l_orderkey::bigint l_orderkey, case when len(gold) > 0 then list_has_any(ids[1:3], gold) end as overlap3, list_has_any(ids[1:1], gold) as hit1 from o""")
def overlap_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some of an order's first ids is gold, ids as trimmed text; an order without gold ids has no answer, or a miss."""
    hit = F.when(F.size("gold") > 0, R.overlap(F.col("ids"), F.col("gold"), 3))
    return _ids_and_gold(spark, sf_dir).select("l_orderkey", hit.alias("overlap3"), R.overlap(F.col("ids"), F.col("gold"), 1).alias("hit1"))


def _ids_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    o = lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey")).agg(entry.alias("e"))
    ids = F.transform("e", lambda x: F.concat((x["l_partkey"] % 7).cast("string"), F.lit(" ")))
    gold = F.transform(F.filter("e", lambda x: x["l_suppkey"] % 7 < 3), lambda x: F.concat(F.lit(" "), (x["l_suppkey"] % 7).cast("string")))
    return o.select("l_orderkey", ids.alias("ids"), gold.alias("gold"))


@query("""with o as (select l_orderkey, list_filter(list(l_partkey % 7 order by l_linenumber), lambda x: l_orderkey % 5 > 0) ids, list_filter(list(l_suppkey % 7 order by l_linenumber), lambda x: x < 3) gold from lines group by 1)
select count(*) n_rows, count(*) filter (where len(gold) = 0) n_empty_gold, count(*) filter (where len(ids) = 0) n_empty_retrieval, round(avg(list_has_any(ids[1:1], gold)::int), 6) recall_at_1, round(avg(list_has_any(ids[1:2], gold)::int), 6) recall_at_2 from o""")
def tolerant_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over orders with ids as text, empty lists as misses, and their counts: each fifth order has retrieved nothing."""
    o = _ids_and_gold(spark, sf_dir)
    out = R.tolerant_recall(o.withColumn("ids", F.when(F.col("l_orderkey") % 5 > 0, F.col("ids")).otherwise(F.array().cast("array<string>"))), "ids", "gold", (1, 2))
    return out.select("n_rows", "n_empty_gold", "n_empty_retrieval", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_2")])


@query("""with p as (select *, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b, lead(p_name, 1, p_type) over (order by p_partkey) nxt from part)
select p_partkey::bigint p_partkey, contains(p_brand || '_' || nxt, a) or contains(p_type, a) in_title, contains(nxt, b) or contains(p_type, b) in_document, nxt = p_name or p_type = p_name as same_document from p""")
def gold_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title that is part of a gold id, a document that is part of a gold one, and one that equals it: the gold of a part is its next."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_type")
    placed = M.running(p, [], "p_partkey", F.lit(1), "i")
    after = placed.select((F.col("i") - 1).alias("i"), F.col("p_name").alias("next"))
    both = placed.join(after, "i", "left").withColumn("next", F.coalesce("next", "p_type"))
    part = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    gold = F.array("next", "p_type")
    return both.select("p_partkey", R.title_in_gold(part(1), F.array(F.concat_ws("_", "p_brand", "next"), F.col("p_type"))).alias("in_title"), R.document_in_gold(F.concat(part(2), F.lit("\n\n")), gold).alias("in_document"), R.document_in_gold(F.col("p_name"), gold, equal=True).alias("same_document"))


@query("""select count(distinct l_partkey) filter (where l_partkey % 5 = 0) n_missing, count(*) filter (where l_partkey % 5 != 0) n_with_text from (select distinct l_orderkey, l_partkey from lineitem)""")
def passages_of_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked passages with their texts, and those ids that the passage table lacks."""
    ranked = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("passage_id")).distinct()
    p = readers.passages(read(spark, sf_dir, "part").where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("passage_id"), F.col("p_name").alias("passage_content"), F.col("p_size").alias("o")), order="o")
    missing = R.missing_passages(ranked, p).agg(F.count(F.lit(1)).alias("n_missing"))
    return missing.join(R.attach_text(ranked, p).agg(F.count("passage_content").alias("n_with_text")))


@query("""select a || '/' || b || '/' || c || '/' || d || '/' || e || '/' || f || '/' || g || '/' || h || '/' || i as config, a, b, i from (select unnest(['fp16', 'fp8']) a), (select unnest([1, 2, 4]) b), (select distinct o_orderstatus c from orders), (select distinct l_returnflag d from lineitem),
(select r_name e from region where r_regionkey < 2), (select distinct lang f from documents where lang is not null), (select distinct quality g from labels where quality is not null), (select distinct toxic h from labels where toxic is not null), (select distinct p_size % 2 i from part)""")
def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of nine settings, each one row."""
    values = lambda t, c, name: read(spark, sf_dir, t).select(c.alias(name)).where(F.col(name).isNotNull()).distinct()
    tables = [
        spark.createDataFrame([("fp16",), ("fp8",)], "a string"), spark.createDataFrame([(1,), (2,), (4,)], "b int"), values("orders", F.col("o_orderstatus"), "c"), values("lineitem", F.col("l_returnflag"), "d"),
        read(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_name").alias("e")), values("documents", F.col("lang"), "f"), values("labels", F.col("quality"), "g"), values("labels", F.col("toxic"), "h"), values("part", F.col("p_size") % 2, "i"),
    ]
    return Q.config_matrix(tables).select(F.concat_ws("/", *[F.col(x).cast("string") for x in "abcdefghi"]).alias("config"), "a", "b", "i")


# Aggregates


@query("""select round(avg(l_quantity), 6) avg_l_quantity, round(avg(l_tax), 6) avg_l_tax, round(avg((l_linenumber = 1)::int), 6) hit_rate, round(avg(l_discount) filter (where l_linenumber != 1), 6) discount_given_calls, max(l_quantity) as most from lineitem""")
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all metric columns, a hit rate, a mean over the rows with calls, and a running counter's average and maximum."""
    line = read(spark, sf_dir, "lineitem")
    means = N.column_means(line, ["l_quantity", "l_tax"])
    more = line.agg(F.round(N.share(F.col("l_linenumber") == 1), 6).alias("hit_rate"), F.round(N.mean_where(F.col("l_discount"), F.col("l_linenumber") != 1), 6).alias("discount_given_calls"), F.max("l_quantity").alias("most"))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns]).join(more)


@query("""with r as (select o_custkey run, avg(o_totalprice) score, count(*) filter (where o_orderstatus = 'F') / count(*) r1, count(*) filter (where o_orderstatus in ('F', 'O')) / count(*) r5 from orders group by 1)
select 'score' as measure, null::int as k, round(avg(score), 4) as value from r union all select 'recall_at_k', 1, round(avg(r1), 4) from r union all select 'recall_at_k', 5, round(avg(r5), 4) from r""")
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over runs of a scalar and of a map from k to recall."""
    share = lambda *s: F.count_if(F.col("o_orderstatus").isin(*s)) / F.count(F.lit(1))
    r = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"), F.create_map(F.lit(1), share("F"), F.lit(5), share("F", "O")).alias("recall_at_k"))
    return N.run_means(r, ["score"], "recall_at_k").withColumn("value", F.round("value", 4))


@query("""select t as strong, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, count(*) n from (select o_totalprice >= 150000 t, o_custkey a, o_orderkey % 100 b from orders) group by 1""")
def means_by_other_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two systems by whether a third one got the question right."""
    o = read(spark, sf_dir, "orders")
    label = o.select("o_orderkey", (F.col("o_totalprice") >= 150000).alias("strong"))
    rows = o.select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"))
    out = N.means_by_label(rows, label, "o_orderkey", "strong", ["a", "b"])
    return out.select("strong", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b")], "n")


@query("""select count(*) num_samples, count(*) filter (where c_acctbal > 0) num_positive, count(*) filter (where c_acctbal <= 0) num_negative, round(avg(n), 6) avg_passages from (select c_custkey, c_acctbal, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1, 2)""")
def needle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with and without a needle, and the mean number of their passages."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("passages"))
    c = read(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    out = N.needle_report(c.select((F.col("c_acctbal") > 0).alias("has_needle"), F.coalesce("passages", F.array().cast("array<bigint>")).alias("passages")))
    return out.withColumn("avg_passages", F.round("avg_passages", 6))


@query("""select round(avg((l_quantity > l_linenumber * 7)::int), 6) accuracy, count(*) n from lineitem""")
def preference_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the chosen answer has the greater reward."""
    out = N.preference_accuracy(read(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_linenumber") * 7)
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("""with a as (select event_id, coalesce(try_cast(regexp_extract_all('the answer is ' || (case when event_id % 5 = 0 then 'none' else (event_id % 7) || ',' || '1' || (event_id % 10) end), '[0-9,]+', 0)[-1].replace(',', '') as bigint), -9999999) p, ((event_id % 7) || '13')::bigint y from events)
select round(avg((p = y)::int), 6) accuracy, round(avg((p = -9999999)::int), 6) invalid_rate, count(*) num_questions, round(count(*) / 30.0, 6) questions_per_second, round(sum(event_id % 50) / 30.0, 6) tokens_per_second from a""")
def integer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the last whole number in an answer, the share of answers without one, and throughput."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    s = lambda x: x.cast("string")
    answer = F.concat(F.lit("the answer is "), F.when(n % 5 == 0, F.lit("none")).otherwise(F.concat(s(n % 7), F.lit(",1"), s(n % 10))))
    rows = e.select(answer.alias("answer"), F.concat(s(n % 7), F.lit("13")).cast("long").alias("label"), (n % 50).alias("tokens"))
    out = N.integer_report(rows, T.last_integer(F.col("answer")), F.col("label"), F.col("tokens"), 30.0)
    return out.select(*[F.round(c, 6).alias(c) if c != "num_questions" else F.col(c) for c in out.columns])


@query("""with q as (select user_id, list(event_type order by event_id) q from events group by 1) select user_id::bigint user_id, len(q)::bigint retriever_calls, round(list_avg(list_transform(q, lambda x: length(x))), 6) mean_query_len from q union all select -1, 0, 0.0""")
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a question called the retriever, and its queries' mean length; 0 without a call."""
    q = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e")).select("user_id", F.transform("e", lambda x: x["event_type"]).alias("queries"))
    none = spark.createDataFrame([(-1, [])], "user_id long, queries array<string>")
    m = R.query_metrics(F.col("queries"))
    return q.unionByName(none).select("user_id", m["calls"].cast("long").alias("retriever_calls"), F.round(m["mean_length"], 6).alias("mean_query_len"))


@query("""select round(avg(p), 6) mean_perplexity, round(min(p), 6) least, count(*) n from (select l_orderkey, exp(-avg(case when l_linenumber % 3 != 0 then ln(1 - l_tax) end)) p from lineitem group by 1)""")
def mean_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each row's unmasked tokens, and its mean over the rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.ln(1 - F.col("l_tax"))).alias("lp"))
    each = E.perplexity(rows, "l_orderkey", "lp")
    return each.agg(F.round(F.avg("perplexity"), 6).alias("mean_perplexity"), F.round(F.min("perplexity"), 6).alias("least"), F.count(F.lit(1)).alias("n"))


@query("""select regexp_extract('k' || l_linenumber || 'x' || (l_orderkey % 3), 'k([0-9]+)x([0-9]+)', 1) as m, (l_orderkey % 3)::varchar as n, count(*)::bigint as size, round(min(l_quantity), 4) least, round(max(l_quantity), 4) most, round(quantile_disc(l_quantity, 0.5), 4) middle from lineitem group by 1, 2""")
def measured_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements gathered by the shape that their label names, in rising order: the ends and the lower middle of each list."""
    line = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), F.col("l_linenumber").cast("string"), F.lit("x"), (F.col("l_orderkey") % 3).cast("string")).alias("label"), "l_quantity")
    g = N.grouped_by_label(line, "label", r"k(\d+)x(\d+)", ["m", "n"], "l_quantity")
    at = lambda place: F.round(F.max(F.when(F.col("place") == place, F.col("l_quantity"))), 4)
    return g.groupBy("m", "n").agg(F.count(F.lit(1)).alias("size"), at(F.lit(0)).alias("least"), at(F.col("of") - 1).alias("most"), at(F.floor((F.col("of") - 1) / 2)).alias("middle"))


@query("""with p as (select o_orderpriority grp, o_orderstatus st, avg(o_totalprice) v from orders group by 1, 2) select grp, round(max(v) filter (where st = 'F'), 4) "F", round(max(v) filter (where st = 'O'), 4) "O", round(max(v) filter (where st = 'P'), 4) "P" from p group by 1""")
def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by pipeline and measure, one row for each pipeline; taken apart again and put together."""
    p = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("st")).agg(F.avg("o_totalprice").alias("v"))
    once = N.wide(p, "grp", "st", F.max("v"), ["F", "O", "P"])
    again = N.wide(N.unpivot(once, ["grp"], ["F", "O", "P"]), "grp", "measure", F.max("value"), ["F", "O", "P"])
    return again.select("grp", *[F.round(c, 4).alias(c) for c in "FOP"])


@query("""select user_id::bigint state, round(coalesce(max(value) filter (where event_id % 3 = 0), 0), 6) "0", round(coalesce(max(value) filter (where event_id % 3 = 1), 0), 6) "1", round(coalesce(max(value) filter (where event_id % 3 = 2), 0), 6) "2" from events group by 1""")
def state_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest weight of each state in each segment."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("segment"), F.array(F.col("user_id").cast("long")).alias("states"), F.array("value").alias("weights"))
    h = N.heatmap(e, "states", "weights", "segment", [0, 1, 2])
    return h.select("state", *[F.round(c, 6).alias(c) for c in "012"])


@query("""with a as (select o_orderpriority model, o_orderstatus st, avg(o_totalprice) v from orders where o_orderkey % 2 = 0 group by 1, 2), b as (select o_orderpriority model, o_orderstatus st, avg(o_totalprice) v from orders where o_orderkey % 2 = 1 group by 1, 2)
select model, st, round(a.v, 4) as a, round(b.v, 4) as b, round(b.v / a.v, 6) ratio from a join b using (model, st)""")
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result tables on one configuration and the ratio of their measures."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("st"), "o_totalprice")
    side = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("model", "st").agg(F.avg("o_totalprice").alias("v"))
    out = N.compare_runs(side(0), side(1), ["model", "st"], "v")
    return out.select("model", "st", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("ratio", 6).alias("ratio"))


@query("""select user_id::bigint user_id, min(event_id * 1.0)::double queued_ts, min(event_id + value) scheduled_ts from events group by 1""")
def group_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are queued and scheduled when their first child is."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("double").alias("queued_ts"), (F.col("event_id") + F.col("value")).alias("scheduled_ts"))
    return L.group_times(e, "user_id")


@query("""select event_type, round(avg(value * user_id / 1000.0), 6) in_flight from events group by 1""")
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in flight by Little's law."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(L.workload_estimate(F.col("value"), F.col("user_id")), 6).alias("in_flight"))


@query("""select count(n_chars) n, min(n_chars)::bigint min, max(n_chars)::bigint max, round(avg(n_chars), 6) mean, round(quantile_cont(n_chars, 0.5), 6) p50, round(quantile_cont(n_chars, 0.9), 6) p90 from documents""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.length_summary(read(spark, sf_dir, "documents"), "n_chars")
    return out.select("n", F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p90")])


# Sets and mixes


@query("""select 'a' as _dataset_name, c_custkey::bigint as id, c_name as name, null::double as balance from customer union all select 'b', s_suppkey, null, s_acctbal from supplier""")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of data sets with different columns under their data set's name."""
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").cast("double").alias("balance"))
    return M.concatenate({"a": a, "b": b})


_DRAWS = """with z as (select count(*) z from documents), sl as (select s slot, ('0x' || left(md5('7:' || s), 13))::bigint / 4503599627370496.0 u from (select unnest(range(SLOTS)) s from z)),
k as (select slot, case when u < 0.4 then 'de' when u < 0.7 then 'en' when u < 0.9 then 'fr' else 'es' end lang from sl),
n as (select *, row_number() over (partition by lang order by slot) - 1 i from k), d as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 j, count(*) over (partition by lang) c from documents)"""

_WEIGHTS = {"de": 4.0, "en": 3.0, "fr": 2.0, "es": 1.0}


@query(_DRAWS.replace("SLOTS", "z") + """ select n.slot::bigint slot, n.lang, doc_id::bigint doc_id from n join d on n.lang = d.lang and n.i % d.c = d.j""")
def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many places as documents, dealt to the languages by weight; each gives its rows in order and starts again at its end."""
    d = read(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("long").alias("doc_id"))
    return M.mix_by_weight(d, "lang", "doc_id", _WEIGHTS, None, 7).select("slot", "lang", "doc_id")


@query(_DRAWS.replace("SLOTS", "20 * z + 1000") + """,
x as (select lang, max(c) c from d group by 1), e as (select min(slot) least, max(slot) most from (select min(slot) slot from n join x using (lang) where i = c - 1 group by n.lang)),
a as (select 'first_exhausted' as strategy, n.slot, n.lang, doc_id from n join d on n.lang = d.lang and n.i % d.c = d.j, e where n.slot <= least
union all select 'all_exhausted', n.slot, n.lang, doc_id from n join d on n.lang = d.lang and n.i % d.c = d.j, e where n.slot <= most
union all select 'all_exhausted_without_replacement', n.slot, n.lang, doc_id from n join d on n.lang = d.lang and n.i = d.j, e where n.slot <= most)
select strategy, slot::bigint slot, lang, doc_id::bigint doc_id from a""")
def weighted_mix_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mix with each rule of where it stops."""
    d = read(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("long").alias("doc_id"))
    out = None
    for s in ("first_exhausted", "all_exhausted", "all_exhausted_without_replacement"):
        m = M.mix_by_weight(d, "lang", "doc_id", _WEIGHTS, None, 7, strategy=s).select(F.lit(s).alias("strategy"), "slot", "lang", "doc_id")
        out = m if out is None else out.unionByName(m)
    return out


@query("""select doc_id::bigint doc_id, 'eval_dataset' || case when doc_id % 2 = 0 then '' else '_' || lang end as route from documents where doc_id % 2 = 0 or lang = 'fr' union all select doc_id, 'train_dataset' from documents""")
def split_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named splits under the trainer's names; others are left out."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    found = M.routes({"train": d, "validation": d.where("doc_id % 2 = 0"), "validation_fr": d.where("doc_id % 2 != 0 and lang = 'fr'"), "test": d})
    out = None
    for name, df in found.items():
        r = df.select("doc_id", F.lit(name).alias("route"))
        out = r if out is None else out.unionByName(r)
    return out


@query("""with h as (select doc_id, row_number() over (order by md5('4:' || doc_id)) r from documents) select doc_id::bigint doc_id, case when r <= 25 then 'validation' else 'train' end split from h""")
def split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation set of a fixed number of rows."""
    return M.split(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", 25, 4)


@query("""with t as (select doc_id, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x != '')) w from documents), q as (select (select w from t where doc_id = 1) as q)
select doc_id::bigint doc_id, len(list_intersect(w, q))::int shared from t, q""")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words that each document has in common with one document."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = d.where("doc_id = 1").select(F.col("text").alias("q"))  # one row
    return d.join(F.broadcast(one)).select("doc_id", T.shared_words(F.col("text"), F.col("q")).alias("shared"))
