"""Streaming queries, drained over what is there. Open windows have not closed when a stream is drained, so the SQL leaves out
what the watermark has not passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caches as K
from ..operators import mixing as M
from ..streaming import branches as G
from ..streaming import buffers as B
from ..streaming import streams as S
from .base import query, read


@query("""with m as (select max(ts) - interval 1 hour w from events) select date_trunc('day', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events, m
group by 1, 2, w having date_trunc('day', ts) + interval 1 day <= w""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available(S.tumbling(S.event_stream(spark, sf_dir), "1 day", "1 hour", "event_type"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 21600000000 then 0 else 1 end b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g), m as (select max(ts) - interval 1 hour w from events)
select min(ts) as start, max(ts) + interval 6 hour as "end", user_id, count(*) n from s, m group by user_id, k, w having max(ts) + interval 6 hour <= w""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available(S.sessions(S.event_stream(spark, sf_dir), "6 hours", "1 hour", "user_id"), "sessions")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("""select distinct event_id from events""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.event_stream(spark, sf_dir)
    return S.run_available(S.deduplicated(events.unionByName(events), "1 hour", "event_id").select("event_id"), "dedup")


@query("""with recursive e as (select event_type || '-' || (user_id % 4) grp, event_id, ceil(value)::bigint n, row_number() over (partition by event_type, user_id % 4 order by event_id) i from events),
r as (select grp, event_id, i, 0::bigint batch, 0 place, n used from e where i = 1
union all select e.grp, e.event_id, e.i, case when used + n > 2048 then batch + 1 else batch end, case when used + n > 2048 then 0 else place + 1 end, case when used + n > 2048 then n else used + n end from r join e on e.grp = r.grp and e.i = r.i + 1)
select grp, event_id::bigint row_id, batch, place::int place from r qualify batch < max(batch) over (partition by grp)""")
def stream_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 2048 tokens out of four buffers for each event type; what fills no batch stays in its buffer."""
    worker = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    events = S.event_stream(spark, sf_dir).withColumn("tokens", F.ceil("value")).withColumn("worker", worker)
    return S.run_available(B.token_batches(events, "worker", "tokens", "event_id", capacity=1 << 20, budget=2048), "batches").drop("refused")


@query("""with recursive e as (select event_type || '-' || (user_id % 4) grp, event_id, ceil(value)::bigint n, row_number() over (partition by event_type, user_id % 4 order by event_id) i from events),
r as (select grp, event_id, i, 0::bigint batch, 0 place, n > 300 refused, case when n > 300 then 0 else n end used, case when n > 300 then 0 else 1 end held, 0::bigint next from e where i = 1
union all select grp, event_id, i, next, held, refused, case when refused then used when held = 5 then 0 else used + n end, case when refused then held when held = 5 then 0 else held + 1 end, case when held = 5 and not refused then next + 1 else next end
from (select e.grp, e.event_id, e.i, e.n, r.used, r.held, r.next, r.used + e.n > 300 refused from r join e on e.grp = r.grp and e.i = r.i + 1)),
m as (select grp, max(next) ends from r group by 1)
select r.grp, event_id::bigint row_id, case when not refused then batch end as batch, case when not refused then place end::int as place, refused from r join m on r.grp = m.grp where refused or batch < ends""")
def stream_bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of six rows out of buffers that hold 300 tokens at most and refuse what is more."""
    worker = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    events = S.event_stream(spark, sf_dir).withColumn("tokens", F.ceil("value")).withColumn("worker", worker)
    return S.run_available(B.token_batches(events, "worker", "tokens", "event_id", capacity=300, take=6), "bounded")


@query("""with recursive e as (select event_type g, event_id::bigint event_id, row_number() over (partition by event_type order by event_id) - 1 i from events),
r as (select g, i, [event_id] held, null::bigint row_id, null::bigint place from e where i = 0
union all select g, i, case when i < 32 then list_append(held, event_id) else list_concat(held[:pos - 1], [event_id], held[pos + 1:]) end, case when i >= 32 then held[pos] end, case when i >= 32 then i - 32 end
from (select e.g, e.i, e.event_id, r.held, ('0x' || left(md5('3:' || e.g || ':' || e.i), 13))::bigint % 32 + 1 as pos from r join e on e.g = r.g and e.i = r.i + 1))
select g as grp, row_id, place from r where place is not null""")
def stream_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type as a reservoir of 32 rows gives them."""
    return S.run_available(B.shuffled_stream(S.event_stream(spark, sf_dir), "event_type", "event_id", 32, 3), "shuffled")


@query("""select event_type as grp, event_id::bigint as row_id, (row_number() over (partition by event_type order by event_id) - 1)::bigint as place from events qualify place >= 100 and place < 150""")
def stream_take_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events of each type after the first hundred."""
    return S.run_available(B.window_of_stream(S.event_stream(spark, sf_dir), "event_type", "event_id", skip=100, take=50), "window")


@query("""with r as (select event_id // 4 grp, event_id % 4 branch, s as step, -value / 100 - 0.1 * s logp, (event_id % 3)::double prior from events, (select unnest([0, 1]) s)),
f as (select grp from r group by 1 having count(*) = 8), p as (select r.*, prior + coalesce(sum(logp) over (partition by r.grp, branch order by step rows between unbounded preceding and 1 preceding), 0) sc from r join f using (grp))
select grp, step::int as step, round(ln(sum(exp(sc + logp))) - ln(sum(exp(sc))), 6) marginal from p group by 1, 2""")
def stream_branch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.event_stream(spark, sf_dir).select("event_id", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    shards = e.select(
        F.floor(F.col("event_id") / 4).alias("grp"), (F.col("event_id") % 4).alias("branch"), "step", (-F.col("value") / 100 - 0.1 * F.col("step")).alias("logp"), (F.col("event_id") % 3).cast("double").alias("prior_logit"),
        F.lit(4).alias("n_branches"), F.lit(2).alias("n_steps"),
    )
    return S.run_available(G.branch_groups(shards), "branches").select("grp", "step", F.round("marginal", 6).alias("marginal"))


@query("""with e as (select event_id // 4 grp, event_id % 4 branch, (event_id % 3)::double s0, [-value / 50 * (1 + (event_id + s) % 3) for s in range(3)] l from events where event_id % 4 <= (event_id // 4) % 4),
f as (select grp from e group by 1 having count(*) = 1 + grp % 4), a as (select e.* from e join f using (grp)),
m0 as (select grp, 0 step, ln(sum(exp(s0 + l[1]))) - ln(sum(exp(s0))) marginal, count(*) n_live from a group by grp),
b as (select *, s0 + l[1] s1, exp(s0 + l[1]) / sum(exp(s0 + l[1])) over (partition by grp) p from a),
c as (select * from b qualify coalesce(sum(p) over (partition by grp order by s1 desc, branch rows between unbounded preceding and 1 preceding), 0) < 0.75),
m1 as (select grp, 1 step, ln(sum(exp(s1 + l[2]))) - ln(sum(exp(s1))) marginal, count(*) n_live from c group by grp),
d as (select grp, branch, l, s1 + l[2] s2, exp(s1 + l[2]) / sum(exp(s1 + l[2])) over (partition by grp) p from c),
g as (select * from d qualify coalesce(sum(p) over (partition by grp order by s2 desc, branch rows between unbounded preceding and 1 preceding), 0) < 0.75),
m2 as (select grp, 2 step, ln(sum(exp(s2 + l[3]))) - ln(sum(exp(s2))) marginal, count(*) n_live from g group by grp)
select grp, step::int as step, round(marginal, 6) marginal, n_live::int n_live from (from m0 union all from m1 union all from m2)""")
def stream_branch_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one to four branches over three steps, pruned to 0.75 of the posterior after each; every report comes twice."""
    e = S.event_stream(spark, sf_dir).where("event_id % 4 <= floor(event_id / 4) % 4").select("event_id", "value", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1), F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    grp = F.floor(F.col("event_id") / 4)
    shards = e.select(
        grp.alias("grp"), (F.col("event_id") % 4).alias("branch"), "step", (-F.col("value") / 50 * (1 + (F.col("event_id") + F.col("step")) % 3)).alias("logp"), (F.col("event_id") % 3).cast("double").alias("prior_logit"),
        (1 + grp % 4).alias("n_branches"), F.lit(3).alias("n_steps"),
    )
    return S.run_available(G.branch_groups(shards, top_p=0.75), "pruning").select("grp", "step", F.round("marginal", 6).alias("marginal"), "n_live")


@query("""with m as (select max(ts) - interval 1 hour w from events), e as (select event_type, date_trunc('day', ts) - interval 1 day * k as start from events, (select unnest([0, 1]) k))
select start, event_type, count(*) n from e, m group by 1, 2, w having start + interval 2 day <= w""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available(S.sliding(S.event_stream(spark, sf_dir), "2 days", "1 day", "1 hour", "event_type"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""select event_id::bigint event_id, c_name from events left join customer on user_id = c_custkey""")
def stream_with_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream met with a table on a key."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    joined = S.with_static(S.event_stream(spark, sf_dir), c, "user_id").select(F.col("event_id").cast("long").alias("event_id"), "c_name")
    return S.run_available(joined, "static")


@query("""with a as (select event_type g, event_id i, user_id % 50 k from events), p as (select *, lag(i) over (partition by g, k order by i) p from a),
d as (select p.g, p.i, count(distinct b.k) n from p join a b on p.g = b.g and b.i > p.p and b.i < p.i group by 1, 2)
select p.i::bigint event_id, p.p is not null and coalesce(d.n, 0) < 12 as hit from p left join d on p.g = d.g and p.i = d.i""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of five caches of twelve entries, least recently used out first."""
    a = read(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("long").alias("event_id"), (F.col("user_id") % 50).alias("k"))
    return K.replay(a, ["event_type"], "event_id", "k", 12).select("event_id", "hit")


@query()
def adaptive_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under adaptive replacement."""
    a = read(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("long").alias("event_id"), (F.col("user_id") % 50).alias("k"))
    return K.replay(a, ["event_type"], "event_id", "k", 12, "arc").select("event_id", "hit")


@query("""with r as (select doc_id, row_number() over (order by doc_id) - 1 i from documents) select doc_id::bigint doc_id, (i // 64 * 64 + row_number() over (partition by i // 64 order by md5('2:' || doc_id), doc_id) - 1)::bigint as place from r""")
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which a shuffle buffer of 64 rows gives them."""
    return M.buffer_shuffled(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", 64, 2)
