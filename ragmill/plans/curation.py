"""Queries that build rows: text functions, sampling, mixing, packing, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import arrays as X
from ..functions import text as T
from ..functions.base import seeded
from ..operators import curation as C
from ..operators import ensemble as E
from ..operators import mixing as M
from ..operators import scoring as S
from .base import lines, query, read

_WS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x != '')"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Text


@query("""select doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') first_ten, trim(regexp_replace(text, '\\s+', ' ', 'g')) flat from documents""")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 10).alias("first_ten"), T.normalize_space(F.col("text")).alias("flat"))


@query(f"""select doc_id, len({_WS})::bigint n_words, (length(text) - length(replace(text, ' ', '')) + 1)::bigint n_spaced from documents""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).cast("long").alias("n_words"), T.count_words_by_spaces(F.col("text")).cast("long").alias("n_spaced"))


@query("""select p_partkey, coalesce(string_split(p_brand || '_' || p_name, '_')[2], '') title, 'Title=' || p_name || '; Content=' || p_type evidence, regexp_replace(p_type || '_' || p_size, '^(.+)_\\d+$', '\\1') base_id from part""")
def title_and_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", T.title_of(F.concat_ws("_", "p_brand", "p_name")).alias("title"), T.evidence(F.col("p_name"), F.col("p_type")).alias("evidence"), T.base_document_id(F.concat_ws("_", "p_type", F.col("p_size").cast("string"))).alias("base_id"))


@query(f"""with w as (select doc_id, {_WS} ws from documents)
select doc_id, i::bigint as chunk, array_to_string(ws[i * 80 + 1:i * 80 + 100], ' ') chunk_text from (select doc_id, ws, unnest(range(0, (len(ws) + 79) // 80)) i from w where len(ws) > 0)
union all select doc_id, 0, '' from w where len(ws) = 0""")
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.sliding_chunks(F.col("text"), size=100, overlap=20)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "chunk_text")).withColumn("chunk", F.col("chunk").cast("long"))


@query("""with c as (select l_orderkey, list_sort(list_distinct(list(case l_linenumber % 3 when 0 then 'image' || (l_suppkey % 12) when 1 then 'text' || (l_partkey % 12) end))) c from lines group by 1)
select l_orderkey::bigint l_orderkey, array_to_string(list_filter(c, lambda x: x is not null), ',') cited from c""")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in answers that an order's lines make: texts, images, and brackets that cite nothing."""
    k, text = F.col("l_linenumber") % 3, lambda c: (F.col(c) % 12).cast("string")
    said = F.when(k == 0, F.concat(F.lit("see ![a picture](image"), text("l_suppkey"), F.lit(")."))).when(k == 1, F.concat(F.lit("as ["), text("l_partkey"), F.lit("] says"))).otherwise(F.concat(F.lit("[x"), text("l_partkey"), F.lit("] (image3)")))
    answers = lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey")).agg(F.array_join(F.collect_list(said), "\n").alias("answer"))
    return answers.select("l_orderkey", F.array_join(T.citations(F.col("answer")), ",").alias("cited"))


@query("""select conv_id, turn, case role when 'user' then length(text) + 0.25 when 'assistant' then 0.0 else turn::double end::double score, text is not null and regexp_matches(text, '[^\\x00-\\x7F]') and length(text) between 20 and 2000 valid from conversations""")
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that a judge's texts give after their last mark, 0.0 where none can be read, and texts whose content is valid."""
    c = read(spark, sf_dir, "conversations")
    n = F.concat((F.length("text")).cast("string"), F.lit(".25"))
    said = F.when(F.col("role") == "user", F.concat("text", F.lit("\nScore: 7\nScore: "), n)).when(F.col("role") == "assistant", F.concat(F.lit("Score: "), "text")).otherwise(F.concat(F.lit("Score:"), F.col("turn").cast("string"), F.lit(" ")))
    return c.select("conv_id", "turn", T.judge_score(said).alias("score"), T.content_valid(F.col("text"), 20, 2000).alias("valid"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(table: dict[str, str]) -> str:
    return "case x " + " ".join(f"when {_quoted(a)} then {_quoted(b)}" for a, b in table.items()) + " else x end"


def _marks() -> str:
    out = "t"
    for m in map(_quoted, A.MARKS):
        out = f"replace({out}, {m}, case when contains(t, {m} || ' ') or contains(t, ' ' || {m}) or th then '' else ' ' end)"
    return out


@query(f"""with a as (select conv_id, turn, trim(translate(text, chr(10) || chr(9), '  ')) t from conversations where role = 'assistant'), b as (select *, regexp_matches(t, '\\d,\\d') th from a),
k as (select conv_id, turn, t, string_split({_marks()}, '') ch from b), d as (select *, list_filter(range(1, len(ch) + 1), lambda i: ch[i] = '.' and not coalesce(ch[i + 1] between '0' and '9', false))[1:32] dr from k),
e as (select conv_id, turn, t, array_to_string(list_filter(ch, lambda x, i: not list_contains(dr, i)), '') v from d),
w as (select conv_id, turn, t, array_to_string(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(lower(v), '\\s+'), lambda x: x != ''), lambda x: {_cases(A.NUMBER_WORDS)}), lambda x: x not in ({", ".join(map(_quoted, A.ARTICLES))})), lambda x: {_cases(A.CONTRACTIONS)}), ' ') n from e),
g as (select conv_id, list(t order by turn) pl, list(n order by turn) nm from w group by 1), o as (select conv_id, nm, case when len(list_distinct(pl)) > 1 then nm else pl end own from g)
select conv_id, round(list_avg(list_transform(own, lambda x: least(1.0, (len(list_filter(own, lambda y: y = own[1])) - (x = own[1])::int) / 3.0))), 6) accuracy, nm[1] as answer from o""")
def answer_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's assistant turns, whole, as gold answers and its first as the prediction."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("a"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "a"))), lambda x: x["a"]).alias("answers"))
    return g.select("conv_id", F.round(A.consensus(F.get("answers", 0), F.col("answers")), 6).alias("accuracy"), A.normalize_answer(F.get("answers", 0)).alias("answer"))


@query()
def text_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE of each conversation's second turn against its first, both whole."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate("rp")])
    c = c.where("p is not null and r is not null")
    return _rounded(c.select("conv_id", S.rouge(T.words(F.col("p")), T.words(F.col("r"))).alias("s")).select("conv_id", "s.*"))


# Conversations


@query("""with c as (select conv_id, list(role order by turn) roles, sum(length(text)) n_chars, count(*) n_turns from conversations group by 1)
select conv_id, n_turns, n_chars::bigint n_chars, len(list_filter(roles, lambda r, i: r != case when (i - 1) % 2 = 0 then 'user' else 'assistant' end)) = 0 alternating from c""")
def turn_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    return c.select("conv_id", "n_turns", "n_chars", C.alternating(F.col("m")).alias("alternating"))


@query("""select conv_id, turn, 'user' as role0, text as value0, r as value1 from (select *, lead(text) over (partition by conv_id order by turn) r, lead(role) over (partition by conv_id order by turn) rr from conversations)
where role = 'user' and rr = 'assistant'""")
def alpaca_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs as canonical messages: pairs meet on their turn numbers, no window is needed."""
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", "text")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    m = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", C.from_alpaca(F.col("text"), F.lit(""), F.col("r")).alias("m"))
    part = lambda i: F.get(F.get("m", i)["content"], 0)["value"]
    return m.select("conv_id", "turn", F.get("m", 0)["role"].alias("role0"), part(0).alias("value0"), part(1).alias("value1"))


@query("""select c_custkey, 'A' || c_custkey as response, true as tag from customer union all select c_custkey, c_name, false from customer""")
def dpo_to_kto(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("chosen"), F.col("c_name").alias("rejected"))
    return C.preferences_to_binary(pairs)


# Sampling


@query("""select doc_id from documents order by md5('7:' || doc_id), doc_id limit 50""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample(read(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 7)


@query("""with c as (select l_orderkey, list(l_partkey order by l_linenumber) ids from lines group by 1)
select l_orderkey, ids[1] gold, (list_sort(list_transform(list_filter(ids[1:50], lambda x: x != ids[1]), lambda x: {'h': md5('3:' || l_orderkey || ':' || x), 'c': x})))[1].c negative from c""")
def balanced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    gold = F.get("ids", 0)
    return c.select("l_orderkey", gold.alias("gold"), C.negative(F.col("ids"), F.array(gold), 3, F.col("l_orderkey")).alias("negative"))


@query("""with l as (select o_custkey k, list(o_orderkey order by o_orderdate, o_orderkey)[1:20] ids from orders group by 1 having count(*) >= 20),
g as (select k, ids, (k % 20 + 1)::int r, 6 + (('0x' || left(md5('11:' || k || ':6'), 13))::bigint % 5)::int t from l)
select k, array_to_string(case when r between 6 and 10 then ids else list_transform(ids, lambda x, i: case when i = r then ids[t] when i = t then ids[r] else x end) end, ',') ids from g""")
def gold_position_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("e")).where(F.size("e") >= 20)
    rows = rows.select(F.col("o_custkey").alias("k"), F.slice(F.transform("e", lambda x: x["o_orderkey"]), 1, 20).alias("ids"), (F.col("o_custkey") % 20 + 1).cast("int").alias("r"))
    return rows.select("k", F.array_join(C.gold_placed(F.col("ids"), F.col("r"), 6, 10, 11, F.col("k")).cast("array<string>"), ",").alias("ids"))


@query("""with r as (select l_orderkey e, l_linenumber c, l_linenumber = 1 g, l_returnflag = 'A' s from lines),
o as (select *, row_number() over (partition by e order by (not s)::int, case when s then '' else md5('5:' || e || ':' || c) end, c) - 1 p from r where not g),
gp as (select e, ('0x' || left(md5('5:' || e || ':gold'), 13))::bigint % 2 gpos from r where g),
m as (select o.e, c, g, p + (p >= gpos)::int pos from o join gp using (e) where p < 4 union all select r.e, c, g, gpos from r join gp using (e) where g)
select e example_id, c chunk_id, g is_gold, pos::bigint as position from (select *, count(*) over (partition by e) n from m where pos < 4) where n = 4""")
def nested_prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("chunk_id"), (F.col("l_linenumber") == 1).alias("is_gold"), (F.col("l_returnflag") == "A").alias("same_document"), F.col("l_linenumber").alias("chunk_order"))
    out = C.nested_prefix(rows, (2, 4), 5)
    return out.withColumn("position", F.col("position").cast("long"))


@query("""with d as (select l_orderkey q, l_linenumber i, l_returnflag kind, l_linenumber = 2 gold, md5('9:' || l_orderkey || ':' || l_linenumber) h from lines),
k as (select *, row_number() over (partition by q, kind order by gold desc, h, i) kr from d),
p as (select *, row_number() over (partition by q order by gold desc, (kr > case when kind = 'A' then 1 else 3 end)::int, h, i) r from k)
select q question_id, i quote_id, kind, gold is_gold from p where r <= 3""")
def balanced_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("quote_id"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") == 2).alias("is_gold"))
    return C.balanced_passages(rows, 3, 9, quotas={"A": 1}).drop("slot")


@query("""with p as (select c_nationkey g, c_custkey id, row_number() over (partition by c_nationkey order by md5('2:' || c_custkey), c_custkey) - 1 i, count(*) over (partition by c_nationkey) m from customer),
t as (select id, g, m, ('0x' || left(md5('2:' || id || ':start'), 13))::bigint % m s from p), k as (select *, unnest(range(0, least(3, m))) k from t),
x as (select k.id target_id, p.id shot_id, k.g, row_number() over (partition by k.id order by k) shot from k join p on p.g = k.g and p.i = (k.s + k.k) % k.m where p.id != k.id)
select target_id::bigint target_id, shot_id::bigint shot_id, g::int as c_nationkey, shot::int as shot from x where shot <= 2""")
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two other customers of each customer's nation."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_nationkey")
    return C.few_shot(c, c, 2, 2, key="c_custkey", pool_key="c_custkey", by="c_nationkey").select("target_id", "shot_id", "c_nationkey", "shot")


# Mixing and splitting


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 turn from documents), s as (select min(n) least from (select count(*) n from documents group by lang))
select lang, doc_id, turn::bigint turn from r, s where turn < least""")
def interleave_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.interleave(read(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")
    return out.select("lang", "doc_id", F.col("turn").cast("long").alias("turn"))


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 turn, count(*) over (partition by lang) n from documents), m as (select max(n) most from r)
select lang, doc_id, (turn + a * n)::bigint turn from (select *, unnest(range(0, (most - 1 - turn) // n + 1)) a from r, m)""")
def interleave_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.interleave(read(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", "all_exhausted")
    return out.select("lang", "doc_id", F.col("turn").cast("long").alias("turn"))


@query("""with r as (select doc_id, row_number() over (order by md5('4:' || doc_id)) r, count(*) over () n from documents) select doc_id, case when r <= ceil(n * 0.1) then 'validation' else 'train' end split from r""")
def split_train_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 4)


@query("""select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)""")
def anti_unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unfinished(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("""select coalesce(a.k, b.k) k, case when a.k is null then 'only_b' when b.k is null then 'only_a' else 'both' end found_in from (select distinct c_nationkey k from customer) a full join (select distinct s_nationkey k from supplier) b on a.k = b.k""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return M.key_sets(a, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r = 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_wins(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


# Packing


@query("""select lang, doc_id, start::bigint start, (start // 2048)::bigint first_block, ((start + n_chars - 1) // 2048)::bigint last_block
from (select *, coalesce(sum(n_chars) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) start from documents)""")
def pack_fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return M.fixed_blocks(d, "n_chars", 2048, ["lang"], "doc_id").select("lang", "doc_id", "start", "first_block", "last_block")


@query(f"""with w as (select lang, doc_id, unnest({_WS}) x, generate_subscripts({_WS}, 1) i from documents), r as (select lang, length(x) n, row_number() over (partition by lang order by doc_id, i) - 1 p, count(*) over (partition by lang) c from w)
select lang, (p // 512)::bigint block, md5(string_agg(n::varchar, ',' order by p)) ids from r where p // 512 < c // 512 group by 1, 2""")
def cut_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each language (their lengths stand for ids) laid end to end and cut into blocks of 512, without the tail."""
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", F.transform(T.words(F.col("text")), F.length).alias("ids"))
    out = M.cut_blocks(d, "ids", 512, ["lang"], "doc_id")
    return out.select("lang", F.col("block").cast("long").alias("block"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query()
def greedy_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into 8192 characters, batch by batch: a batch is 500 documents of following ids, as the trainer reads them."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("batch", F.floor(F.col("doc_id") / 500))
    return M.greedy_knapsacks(d, "n_chars", 8192, ["batch"], "doc_id")


@query()
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("worker", F.floor(F.col("doc_id") / 500))
    return M.micro_batches(d, "n_chars", 16384, ["worker"], "doc_id")


@query("""with s as (select l_orderkey, l_linenumber, l_quantity::int * 20 src, l_suppkey::int % 700 tgt from lineitem), m as (select *, case when tgt * 2 < 1024 then 1024 when src * 2 < 1024 then 1024 - src else floor(1024 * (tgt / (src + tgt)))::int end mx from s),
t as (select *, least(mx, tgt) nt from m) select l_orderkey, l_linenumber, least(greatest(1024 - nt, 0), src) source, nt target from t""")
def sequence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 20).alias("src"), (F.col("l_suppkey").cast("int") % 700).alias("tgt"))
    return rows.select("l_orderkey", "l_linenumber", X.sequence_budget(F.col("src"), F.col("tgt"), 1024).alias("b")).select("l_orderkey", "l_linenumber", "b.source", "b.target")


@query("""with r as (select doc_id, lang, row_number() over (order by doc_id) - 1 i from documents), b as (select *, i // 1000 k from r)
select doc_id, coalesce(lag(lang) over (partition by k order by i), last(lang) over (partition by k order by i rows between unbounded preceding and unbounded following)) mismatched from b""")
def previous_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.running(read(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("g", F.lit(0)), ["g"], "doc_id", F.lit(1), "i")
    return M.previous_in_batch(d, "lang", "i").select("doc_id", "mismatched")


# Mixtures


_MIX = """
with r as (select l_orderkey grp, l_linenumber branch, s as step, ln(1 - l_tax - 0.01 * s) logp, l_discount prior_logit from lines, (select unnest([0, 1, 2]) s)),
lp as (select *, prior_logit - ln(sum(exp(prior_logit)) over (partition by grp, step)) log_prior from r),
pf as (select *, coalesce(sum(logp) over (partition by grp, branch order by step rows between unbounded preceding and 1 preceding), 0) + log_prior s from lp),
po as (select *, s - ln(sum(exp(s)) over (partition by grp, step)) log_posterior from pf)
"""


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_tax", "l_discount", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("step"))
    rows = line.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("branch"), "step", F.ln(1 - F.col("l_tax") - 0.01 * F.col("step")).alias("logp"), F.col("l_discount").alias("prior_logit"))
    return E.log_prior(rows)


@query(_MIX + "select grp, branch, step, round(log_posterior, 6) + 0.0 log_posterior from po")
def posterior_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.posterior(_mixture(spark, sf_dir)).select("grp", "branch", "step", (F.round("log_posterior", 6) + F.lit(0.0)).alias("log_posterior"))


@query(_MIX + ", m as (select grp, step, ln(sum(exp(logp + log_posterior))) v from po group by 1, 2) select grp, round(-sum(v), 6) loss from m group by 1")
def mixture_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.loss(_mixture(spark, sf_dir)))


@query("""select l_orderkey, round(exp(-avg(ln(1 - l_tax))), 6) perplexity from lineitem group by 1""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.ln(1 - F.col("l_tax")).alias("lp"))
    return _rounded(E.perplexity(rows, "l_orderkey", "lp"))


@query("""with e as (select vec_id, list_transform(embedding::double[], lambda x: exp(x - list_max(embedding::double[]))) z from embeddings), p as (select vec_id, list_transform(z, lambda x: x / list_sum(z)) p from e)
select vec_id, round(list_max(p), 6) top_share, round(list_sum(list_transform(p, lambda x: -x * ln(x))), 6) entropy from p""")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "embeddings").select("vec_id", X.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return _rounded(p.select("vec_id", F.array_max("p").alias("top_share"), X.entropy(F.col("p")).alias("entropy")))


@query("""select l_orderkey, round(sum(l_tax), 6) logprob, round(sum(l_tax) / count(*), 6) normalized from lineitem group by 1""")
def continuation_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_tax")).alias("x"))
    return _rounded(g.select("l_orderkey", E.continuation_logprob(F.col("x"), F.lit(None).cast("double")).alias("logprob"), E.length_normalized(F.col("x")).alias("normalized")))


@query("""select doc_id, md5('1:' || doc_id) as place from documents""")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shuffled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1).withColumn("place", seeded(1, F.col("doc_id")))
