"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import matching as G
from ..operators import mixing as M
from ..operators import retrieval as R
from ..operators import vectors as V
from .base import lines, query, read

_RANKED = """
with q as (select vec_id query_id, label ql, embedding qe from embeddings where vec_id % 20 = 0),
s as (select query_id, ql, c.vec_id passage_id, c.label cl, list_cosine_similarity(qe::double[], c.embedding::double[]) score from q, embeddings c where c.vec_id != query_id),
r as (select *, row_number() over (partition by query_id order by score desc, passage_id) as "rank" from s qualify "rank" <= 10)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth vector asks, all vectors answer; a hit has the question's label."""
    e = read(spark, sf_dir, "embeddings")
    found = V.top_by_cosine(e.where("vec_id % 20 = 0"), e, 10, vector="embedding")
    label = e.select("vec_id", "label")
    found = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return found.join(label.select(F.col("vec_id").alias("passage_id"), F.col("label").alias("cl")), "passage_id")


@query(_RANKED + """, f as (select query_id, min(case when ql = cl then "rank" end) first_rank from r group by 1)
select round(avg(coalesce(1.0 / first_rank, 0)), 6) mrr, round(avg(coalesce((first_rank <= 1)::int, 0)), 6) recall_at_1, round(avg(coalesce((first_rank <= 3)::int, 0)), 6) recall_at_3,
       round(avg(coalesce((first_rank <= 5)::int, 0)), 6) recall_at_5, round(avg(coalesce((first_rank <= 10)::int, 0)), 6) recall_at_10, count(*) n_questions from f""")
def recall_mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("ql") == F.col("cl"), F.col("rank"))).alias("first_rank"))
    out = R.mrr_and_recall(first, (1, 3, 5, 10))
    return out.select(*[F.round(c, 6).alias(c) if c != "n_questions" else F.col(c) for c in out.columns])


@query(_RANKED + """, f as (select query_id, min(case when ql = cl then "rank" end) first_rank from r group by 1)
select k::int as k, round(avg(coalesce((first_rank <= k)::int, 0)), 6) recall from f, (select unnest([1, 3, 5, 10]) k) group by k""")
def recall_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("ql") == F.col("cl"), F.col("rank"))).alias("first_rank"))
    return R.recall_long(first, (1, 3, 5, 10)).withColumn("recall", F.round("recall", 6))


@query(_RANKED + """select query_id, passage_id, "rank", round(score, 6) score from r""")
def top_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query_id", "passage_id", "rank", F.round("score", 6).alias("score"))


@query("""with d as (select source, doc_id, lower(text) t, row_number() over (partition by source order by doc_id) as pos from documents),
a as (select item_id, lower(regexp_extract(text, '^(\\S+ \\S+ \\S+ \\S+)', 1)) a from benchmark),
h as (select item_id, source, min(case when contains(t, a) then pos end) first_rank from d, a where a != '' group by all)
select source, round(avg(coalesce((first_rank <= 5)::int, 0)), 6) pseudo_recall_at_5, round(avg(coalesce((first_rank <= 50)::int, 0)), 6) pseudo_recall_at_50, count(*) n_questions from h group by source""")
def pseudo_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in id order are a ranking; an item's first four words are its answer. The items are the stated query set:
    they are looked for where the texts stand, and the first hit of each item and source then gets its place from a numbering of ids."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.lower("text").alias("t"))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_extract("text", r"^(\S+ \S+ \S+ \S+)", 1)).alias("a")).where("a != ''")
    found = G.contained(docs, items, keep=["source", "doc_id"], text="t", item="item_id", pattern="a")
    first = found.groupBy("item_id", "source").agg(F.min("doc_id").alias("doc_id"))
    placed = M.running(docs.select("source", "doc_id"), ["source"], "doc_id", F.lit(1), "place")
    hits = first.join(placed, ["source", "doc_id"]).select("item_id", "source", (F.col("place") + 1).alias("first_rank"))
    every = items.select("item_id").join(docs.select("source").distinct())  # items x sources, both stated sets
    rate = lambda k: F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 6)
    return every.join(hits, ["item_id", "source"], "left").groupBy("source").agg(rate(5).alias("pseudo_recall_at_5"), rate(50).alias("pseudo_recall_at_50"), F.count(F.lit(1)).alias("n_questions"))


@query("""select doc_id, item_id from documents d, benchmark b where contains(d.text, rtrim(b.text, chr(10)))""")
def contamination_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item as a substring: the items are the stated query set."""
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").withColumn("item", F.regexp_replace("text", r"\n+$", ""))
    return G.contained(d, b, keep=["doc_id"], text="text", item="item_id", pattern="item")


@query("""with r as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as "rank" from documents),
f as (select source, count(*) n, min(case when quality = 0 then "rank" end) first_bad from r left join labels using (doc_id) group by source)
select source, case when first_bad < 50 then first_bad when n >= 50 then 50 else 100 end as gold_rank from f""")
def capped_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by length of each source's first document of low quality, with the caps of the pipeline reports. The rank is the count
    of longer documents, found by two aggregates instead of a sort by source."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    bad = d.join(read(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct(), "doc_id")
    best = bad.groupBy("source").agg(F.min(F.struct((-F.col("n_chars")).alias("c"), "doc_id")).alias("b"))
    ahead = F.coalesce(F.struct((-F.col("n_chars")).alias("c"), "doc_id") <= F.col("b"), F.lit(False))
    counted = d.join(best, "source", "left").groupBy("source").agg(F.count_if(ahead).alias("r"), F.count(F.lit(1)).alias("n"))
    return counted.select("source", R.capped_rank(F.nullif("r", F.lit(0)), F.col("n")).alias("gold_rank"))


@query("""with t as (select l_orderkey, list(l_returnflag order by l_linenumber) flags from lines group by 1)
select count(*) filter (where len(list_distinct(flags[1:3])) < len(flags[1:3])) n_with_duplicates, count(*) n_questions from t""")
def dup_texts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("text")))), lambda x: F.struct(x["text"].alias("text"))).alias("ranked"))
    return R.duplicate_top(rows, "ranked", 3)


@query("""with t as (select l_orderkey, list({'id': l_partkey, 's': l_discount} order by l_discount desc, l_linenumber) p from lines group by 1)
select l_orderkey, p[1].id best_part, list_transform(p[1:3], lambda x: x.id)::varchar top_parts from t""")
def rerank_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a ranked list, reranked by discount; ties keep the first order."""
    entry = F.struct("l_linenumber", F.col("l_partkey").alias("id"), F.col("l_discount").alias("rerank_score"))
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    ranked = R.rerank(F.col("p"))
    return rows.select("l_orderkey", ranked.alias("r")).select("l_orderkey", F.get("r", 0)["id"].alias("best_part"), F.concat(F.lit("["), F.array_join(F.transform(R.top(F.col("r"), 3), lambda x: x["id"].cast("string")), ", "), F.lit("]")).alias("top_parts"))


@query("""with t as (select l_orderkey, list(l_suppkey order by l_linenumber) ids, list(l_discount order by l_linenumber) pr, list(l_tax order by l_linenumber) po,
 min(l_suppkey) gold from lines group by 1),
s as (select gold, ids, list_transform(list_sort(list_transform(range(1, len(ids) + 1), lambda i: {'x': -pr[i], 'i': i})), lambda y: ids[y.i]) a,
 list_transform(list_sort(list_transform(range(1, len(ids) + 1), lambda i: {'x': -po[i], 'i': i})), lambda y: ids[y.i]) b from t)
select round(avg(list_contains(ids, gold)::int), 6) retrieval_hit_rate, round(avg((a[1] = gold)::int), 6) prior_hit_rate, round(avg(list_contains(a[1:1], gold)::int), 6) prior_recall_at_1,
 round(avg(list_contains(a[1:2], gold)::int), 6) prior_recall_at_2, round(avg((b[1] = gold)::int), 6) posterior_hit_rate, round(avg(list_contains(b[1:1], gold)::int), 6) posterior_recall_at_1,
 round(avg(list_contains(b[1:2], gold)::int), 6) posterior_recall_at_2 from s""")
def branch_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_discount", "l_tax")))
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(entry.alias("e"), F.min("l_suppkey").alias("gold_id"))
    ids, pick = F.transform("e", lambda x: x["l_suppkey"]), lambda c: F.transform("e", lambda x: x[c])
    table = rows.select("gold_id", ids.alias("retrieved"), R.ids_by_score(ids, pick("l_discount")).alias("prior_sorted"), R.ids_by_score(ids, pick("l_tax")).alias("posterior_sorted"))
    out = R.branch_report(table, 2)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""with q as (select vec_id, label, embedding::double[] e from embeddings where vec_id % 20 = 0), m as (select q.vec_id, q.label ql, c.label cl, max(list_dot_product(q.e, c.embedding::double[])) m from q, embeddings c group by 1, 2, 3)
select ql query_label, cl::bigint doc_label, round(sum(m), 4) score from m group by 1, 2""")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction: each label's vectors are a document, those of each twentieth id a question."""
    e = read(spark, sf_dir, "embeddings")
    out = V.max_sim(e.where("vec_id % 20 = 0"), e, vector="embedding")
    return out.select(F.col("query_group").alias("query_label"), F.col("doc_group").alias("doc_label"), F.round("score", 4).alias("score"))


@query("""with c as (select conv_id, min(case when turn = 0 then text end) q, min(case when turn = 1 then text end) a from conversations group by 1)
select conv_id, case when coalesce(a, '') = '' or trim(regexp_replace(q, '\\s+', ' ', 'g')) = '' then 1
 when contains(lower(regexp_replace(a, '\\s+', ' ', 'g')), lower(trim(regexp_replace(q, '\\s+', ' ', 'g')))) then 10
 when ov >= 0.8 then 8 when ov >= 0.5 then 5 when ov >= 0.2 then 3 else 1 end score
from (select *, len(list_intersect(list_distinct(nw), list_distinct(rw))) / greatest(len(list_distinct(nw)), 1) ov from
 (select *, list_filter(regexp_split_to_array(lower(coalesce(q, '')), '\\s+'), lambda x: x != '') nw, list_filter(regexp_split_to_array(lower(coalesce(a, '')), '\\s+'), lambda x: x != '') rw from c))""")
def needle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a conversation's first turn its second repeats."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("a"))
    return c.select("conv_id", A.needle_score(F.col("a"), F.col("q")).alias("score"))
