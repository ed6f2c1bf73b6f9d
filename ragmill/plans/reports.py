"""Report queries: conditional means, tables, buckets, percentiles, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import register
from ..operators import analytics as N
from ..operators import telemetry as T
from ..operators.states import Ledger
from ..sources.folders import new_path
from .base import query, read


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""with c as (select quality = 1 a, toxic = 1 b from labels where quality is not null and toxic is not null)
select a, b, grouping(a, b)::bigint margin, count(*) n, round(100.0 * count(*) / (select count(*) from c), 6) percent from c group by cube (a, b)""")
def contingency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.contingency(read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query("""select round(avg(n_chars), 6) mean_all, round(avg(n_chars) filter (where quality = 1), 6) mean_good, round(avg(n_chars) filter (where quality = 0), 6) mean_bad,
 round(avg((toxic = 1)::int) filter (where quality = 1), 6) toxic_given_good, count(*) filter (where quality = 0 and toxic = 1) n_bad_toxic,
 count(*) filter (where quality = 1 and toxic = 1) "both", count(*) filter (where quality = 1 and toxic != 1) only_a, count(*) filter (where quality != 1 and toxic = 1) only_b,
 count(*) filter (where quality != 1 and toxic != 1) neither from labels join documents using (doc_id)""")
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    good, toxic, n = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars")
    out = rows.agg(F.avg(n).alias("mean_all"), N.mean_where(n, good).alias("mean_good"), N.mean_where(n, ~good).alias("mean_bad"), N.mean_where(toxic.cast("int"), good).alias("toxic_given_good"), F.count_if(~good & toxic).alias("n_bad_toxic"), *N.cross_counts(good, toxic))
    return _rounded(out)


@query("""with r as (select lang, n_chars, least(100, n_chars // 200) as "rank" from documents),
b as (select * from (values ('0-1', 0, 0, 1), ('2-3', 1, 2, 3), ('4-5', 2, 4, 5), ('6-10', 3, 6, 10), ('11-25', 4, 11, 25), ('26-49', 5, 26, 49), ('50-100', 6, 50, 100)) t(bucket, position, lo, hi))
select bucket, position, count("rank") n, round(100.0 * count("rank") / (select count(*) from r), 6) percent, round(avg(n_chars), 6) mean_score from b left join r on "rank" between lo and hi group by 1, 2""")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("n_chars", F.least(F.lit(100), F.floor(F.col("n_chars") / 200)).alias("rank"))
    return _rounded(N.rank_buckets(rows, "rank", "n_chars"))


@query("""with c as (select count(*) filter (where toxic = 1 and quality = 1) tp, count(*) filter (where toxic = 1 and quality != 1) fp, count(*) filter (where toxic != 1 and quality = 1) fn,
 count(*) filter (where toxic != 1 and quality != 1) tn from labels)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 from c""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.classification(read(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 1))


@query("""select o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::bigint as grouping, round(100 * avg((o_totalprice > 200000)::int), 2) accuracy, count(*) n
from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority))""")
def grouping_sets_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 200000).cast("int").alias("score"))
    return N.accuracy_by(rows, "score", "o_orderstatus", "o_orderpriority")


@query("""with s as (select n_chars v, row_number() over (order by n_chars) - 1 i, count(*) over () n from documents)
select count(*) n, round(avg(v), 4) mean, max(v) filter (where i = n // 2) upper_median, min(v) min, max(v) max, round(stddev_pop(v), 4) std_pop from s""")
def upper_median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.length_statistics(read(spark, sf_dir, "documents"), "n_chars"), 4)


@query("""with s as (select n_chars v, row_number() over (order by n_chars) - 1 i, count(*) over () n from documents)
select max(v) filter (where i = round_even(0.5 * (n - 1), 0)) p50, max(v) filter (where i = round_even(0.9 * (n - 1), 0)) p90, max(v) filter (where i = round_even(0.95 * (n - 1), 0)) p95, max(v) filter (where i = round_even(0.99 * (n - 1), 0)) p99 from s""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.nearest_rank(read(spark, sf_dir, "documents"), "n_chars", (50, 90, 95, 99))


@query("""select l_returnflag, count(l_quantity) n, min(l_quantity) min, max(l_quantity) max, round(avg(l_quantity), 6) mean, round(quantile_cont(l_quantity, 0.5), 6) p50, round(quantile_cont(l_quantity, 0.9), 6) p90
from lineitem group by 1""")
def interp_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.length_summary(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]))


@query("""with u as (select 'turn' as "column", turn::double v from conversations union all select 'length', length(text)::double from conversations)
select "column", count(v) count, round(avg(v), 4) mean, round(stddev_samp(v), 4) std, min(v) min, round(quantile_cont(v, 0.25), 4) p25, round(quantile_cont(v, 0.5), 4) p50, round(quantile_cont(v, 0.75), 4) p75, round(quantile_cont(v, 0.9), 4) p90,
 round(quantile_cont(v, 0.99), 4) p99, round(quantile_cont(v, 0.999), 4) p99_9, round(quantile_cont(v, 0.9999), 4) p99_99, max(v) max from u group by 1""")
def describe_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("turn", F.length("text").alias("length"))
    return _rounded(T.describe(rows, ["turn", "length"]), 4)


@query("""with e as (select case when epoch_us(ts) = 0 then 0 else greatest(0, value - 1) end ttft, value from events)
select count(*) n_requests, round(count(*) / 60.0, 6) requests_per_s, round(quantile_cont(ttft, 0.5), 6) ttft_p50, round(quantile_cont(ttft, 0.9), 6) ttft_p90, round(quantile_cont(value, 0.5), 6) value_p50, round(quantile_cont(value, 0.9), 6) value_p90 from e""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: value is the total time, all but the first second is time to the first token."""
    rows = read(spark, sf_dir, "events").select("value", T.span(F.lit(1.0), F.col("value")).alias("ttft"))
    return _rounded(T.latency_report(rows, 60.0, ["ttft", "value"]))


@query("""with t as (select event_id, user_id, 100.0 + event_id queued, 100.5 + event_id scheduled, 100.5 + event_id + value first_ts, 100.5 + event_id + 3 * value last_ts, (event_id % 7)::int tokens from events)
select event_id, round(scheduled - queued, 6) queue, round(first_ts - scheduled, 6) prefill, round(first_ts - queued, 6) ttft, round(last_ts - first_ts, 6) decode, round(case when tokens > 1 then (last_ts - first_ts) / (tokens - 1) else 0 end, 6) tpot from t""")
def request_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    q, s, f, last = (F.lit(100.0) + F.col("event_id"), F.lit(100.5) + F.col("event_id"), F.lit(100.5) + F.col("event_id") + F.col("value"), F.lit(100.5) + F.col("event_id") + 3 * F.col("value"))
    return _rounded(e.select("event_id", T.request_timing(q, s, f, last, F.col("event_id") % 7).alias("t")).select("event_id", "t.*"))


@query("""select l_orderkey % 10 grp, round_even(sum(l_quantity * (l_linenumber + 1)) / sum(l_linenumber + 1), 2) weighted_avg from (select l_orderkey, l_linenumber, l_quantity from lineitem) group by 1""")
def weighted_avg_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_orderkey") % 10)
    return N.weighted_average(rows, "l_quantity", "l_linenumber", 7, by=["grp"])


@query("""with p as (select c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) v from customer group by 1, 2)
select c_mktsegment, c_nationkey, case when v is not null then r || case r when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end end place
from (select *, row_number() over (partition by c_mktsegment order by v desc, c_nationkey) r from p)""")
def ordinal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    return N.ordinal(rows, "v", "c_nationkey", ["c_mktsegment"]).select("c_mktsegment", "c_nationkey", "place")


@query("""select l_shipmode, round(exp(avg(ln(l_extendedprice / (l_extendedprice * (1 - l_discount) + 1)))), 6) speedup from (select l_returnflag l_shipmode, * from lineitem) group by 1""")
def geomean_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return _rounded(read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(N.geometric_speedup(price, price * (1 - F.col("l_discount")) + 1).alias("speedup")))


@query("""with b as (select (n_chars // 1000 * 1000)::bigint bin, count(*) n from documents group by 1)
select bin, n, (sum(n) over (order by bin))::bigint n_up_to, round(100.0 * sum(n) over (order by bin) / sum(n) over (), 6) percent_up_to from b""")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.length_distribution(read(spark, sf_dir, "documents"), F.col("n_chars"), 1000))


@query("""with k as (select unnest(json_keys(props)) as key from events) select key, count(*) n, (select count(*) from events) - count(*) n_missing from k group by 1""")
def profile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.profile_json(read(spark, sf_dir, "events"), "props")


@query("""select user_id::varchar as value, count(*) n from events group by 1 order by n desc, value limit 10""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.value_counts(read(spark, sf_dir, "events"), "user_id", 10)


@query("""select event_id, value from events where event_type = 'click' and value >= 5 and value != 7.5 and value < 'inf'::double""")
def filter_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.apply_filters(read(spark, sf_dir, "events"), "event_type=='click',value>=5,value!=7.5,value<inf").select("event_id", "value")


@query("""with e as (select user_id, event_type, epoch_us(ts)::bigint s, (epoch_us(ts) + 60000000 * value)::bigint e from events),
m as (select *, max(e) over (partition by user_id order by s, event_type rows between unbounded preceding and 1 preceding) pm from e)
select event_type, round(sum(greatest(0, e - greatest(s, coalesce(pm, s)))) / 1e6, 3) elapsed, round(sum(e - s) / 1e6, 3) duration, count(*) n from m group by 1""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.to_timestamp("ts"))
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", start.alias("s"), F.rint(start + 60000000 * F.col("value")).cast("long").alias("e"))
    return _rounded(N.interval_summary(rows, "event_type", "s", "e", ["user_id"], per_second=1e6), 3)


@query("""with p as (select round(o_totalprice, -3) x, (o_orderkey % 997)::double y from orders),
b as (select x, max(y) y from p group by 1), m as (select *, max(y) over (order by x desc rows between unbounded preceding and 1 preceding) pm from b)
select x, y from m where pm is null or y >= pm - 1e-9""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.round("o_totalprice", -3).alias("x"), (F.col("o_orderkey") % 997).cast("double").alias("y"))
    return N.pareto_frontier(rows, "x", "y")


@query("""select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) r from lineitem) where r = 1""")
def best_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return N.best_per(rows, ["l_orderkey"], "l_extendedprice", "l_linenumber")


@query("""select * from (select 'longest' category, doc_id from documents order by n_chars desc, doc_id limit 5)
union all select * from (select 'shortest', doc_id from documents order by n_chars, doc_id limit 5)
union all select * from (select 'longest_french', doc_id from documents where lang = 'fr' order by n_chars desc, doc_id limit 5)""")
def top_n_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    take = lambda rows, name, *o: N.top_n(rows, 5, *o, category=name).select("category", "doc_id")
    longest = (F.col("n_chars").desc(), F.col("doc_id"))
    return take(d, "longest", *longest).unionByName(take(d, "shortest", F.col("n_chars"), F.col("doc_id"))).unionByName(take(d.where("lang = 'fr'"), "longest_french", *longest))


@query("""select event_id, case when event_type similar to '.*(purch|sign).*' then 'conversion' when event_type like '%err%' then 'fault' when event_type like '%c%' then 'touch' else 'other' end kind from events""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"purch|sign": "conversion", "err": "fault", "c": "touch"}
    return read(spark, sf_dir, "events").select("event_id", N.first_rule(F.col("event_type"), rules, "other").alias("kind"))


@query("""with s as (select o_orderpriority priority, o_orderstatus st, o_totalprice v from orders)
select * from (select priority, round_even(sum(v) filter (where st = 'F'), 2) "F", round_even(sum(v) filter (where st = 'O'), 2) "O", round_even(sum(v) filter (where st = 'P'), 2) "P" from s group by priority)
union all select 'total', round_even(sum(v) filter (where st = 'F'), 2), round_even(sum(v) filter (where st = 'O'), 2), round_even(sum(v) filter (where st = 'P'), 2) from s""")
def duration_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return N.duration_table(rows, "priority", "st", "v", ["F", "O", "P"]).select("priority", *[F.col(c).cast("double").alias(c) for c in "FOP"])


@query("""select round(max(abs(l_discount - l_tax)), 6) abs_max, round(avg(abs(l_discount - l_tax)), 6) abs_mean, round(min(abs(l_discount - l_tax)), 6) abs_min,
 round(max(abs(l_discount - l_tax) / nullif(abs(l_discount), 0)), 6) rel_max, round(avg(abs(l_discount - l_tax) / nullif(abs(l_discount), 0)), 6) rel_mean, round(min(abs(l_discount - l_tax) / nullif(abs(l_discount), 0)), 6) rel_min,
 round(sqrt(sum((l_discount - l_tax) ** 2)), 6) l2, round(sqrt(sum((l_discount - l_tax) ** 2)) / sqrt(sum(l_discount ** 2)), 6) rel_l2 from lineitem""")
def vector_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.vector_difference(read(spark, sf_dir, "lineitem"), "l_discount", "l_tax"))


@query("""with x as (select o_orderpriority grp, o_orderkey % 16 concurrency, avg(o_totalprice) / 1000 ttft, avg(o_custkey) tpot from orders group by 1, 2)
select grp, max(concurrency) filter (where ttft <= 255 and tpot <= 760) best_concurrency from x group by 1""")
def best_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 16).alias("concurrency")).agg((F.avg("o_totalprice") / 1000).alias("ttft"), F.avg("o_custkey").alias("tpot"))
    return T.best_concurrency(rows, ["grp"], 255, 760)


@query("""with w as (select event_type, 'bucket_' || (user_id % 4) as le, count(*)::double as value from events group by 1, 2)
select event_type, array_to_string(list(le || '=' || value::bigint order by le), ',') buckets from w group by 1""")
def histogram_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type and a bucket label as metric samples, gathered to one digest a label set."""
    w = read(spark, sf_dir, "events").groupBy("event_type", F.concat(F.lit("bucket_"), (F.col("user_id") % 4).cast("string")).alias("le")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    samples = w.select(F.lit("n").alias("name"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("le"), F.col("le")).alias("labels"), "value")
    d = T.histogram_digest(samples)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("buckets")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",")
    return d.select(F.get("labels", 0)["value"].alias("event_type"), text.alias("buckets"))


@query("""with recursive e as (select user_id, event_id, event_type = 'view' gone, row_number() over (partition by user_id order by event_id) i from events),
r as (select user_id, event_id, i, gone as refused, case when gone then 0 else 1 end live from e where i = 1
union all select e.user_id, e.event_id, e.i, case when gone then live = 0 else live = 5 end, case when gone then greatest(live - 1, 0) else least(live + 1, 5) end from r join e on e.user_id = r.user_id and e.i = r.i + 1)
select user_id::bigint user_id, event_id::bigint event_id, live::bigint live, (5 - live)::bigint free, refused from r""")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each user's store of five, taken by events and given back by views; what finds none free or none live is refused."""
    rows = read(spark, sf_dir, "events").select(_long("user_id"), _long("event_id"), F.when(F.col("event_type") == "view", -1).otherwise(1).alias("delta"))
    return T.live_counts(rows, "user_id", "event_id", "delta", 5).drop("delta")


@query("""select user_id::bigint user_id, event_id::bigint event_id, round(avg(value) over w, 6) as mean, round(max(value) over w, 6) as most from events window w as (partition by user_id order by event_id)""")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter's mean and maximum up to each event of its user."""
    e = read(spark, sf_dir, "events").select(_long("user_id"), _long("event_id"), "value")
    return N.running_counters(e, "user_id", "event_id", "value").select("user_id", "event_id", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("""with r as (select o_custkey, count(*) n, sum(o_totalprice) total from orders group by 1), h as (select o_custkey, count(*) items from orders join lineitem on o_orderkey = l_orderkey group by 1)
select c_custkey, coalesce(r.n, 0) n_orders, round(coalesce(r.total, 0), 2) total, coalesce(items, 0) n_items from customer left join r on c_custkey = r.o_custkey left join h on c_custkey = h.o_custkey""")
def left_join_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two systems' results on one key. Each side is summed to the key before it is joined."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    r = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    h = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("k").alias("items"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    out = c.join(r, "o_custkey", "left").join(h, "o_custkey", "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), F.coalesce("items", F.lit(0)).alias("n_items"))


@query("""select r_name, n_name, p_size from region, nation, (select distinct p_size from part)""")
def cross_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three parameter lists: a sweep's grid, whose size is the feature."""
    sizes = read(spark, sf_dir, "part").select("p_size").distinct()
    return read(spark, sf_dir, "region").select("r_name").crossJoin(read(spark, sf_dir, "nation").select("n_name")).crossJoin(sizes)


@query("""with w as (select conv_id, turn, role, unnest(string_split_regex(trim(text, chr(32) || chr(10) || chr(9)), '\\s+')) word, generate_subscripts(string_split_regex(trim(text, chr(32) || chr(10) || chr(9)), '\\s+'), 1) i from conversations),
p as (select *, row_number() over (partition by conv_id order by turn, i) - 1 p, count(*) over (partition by conv_id) n from w where word != ''),
c as (select *, unnest(range(case when p < 40 then 0 else (p - 40) // 30 + 1 end, least(p // 30, greatest(ceil((n - 10) / 30.0), 1) - 1)::bigint + 1)) chunk from p)
select conv_id::bigint conv_id, min(turn)::bigint turn, arg_min(role, p) as role, chunk::bigint chunk, count(*) n_words, count(distinct turn) n_rows, md5(string_agg(word, ' ' order by p)) as words from c group by conv_id, chunk""")
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in chunks of 40 words that share 10, by the table function in SQL."""
    register(spark)
    read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").createOrReplaceTempView("turns_to_chunk")
    out = spark.sql("select * from chunk_rows(table(turns_to_chunk) partition by conv_id order by turn, text => 'text', size => 40, overlap => 10)")
    return out.withColumn("words", F.md5("words"))


@query("""select event_type, 'value' as metric, count(value) as "count", round(avg(value), 6) as mean, round(var_samp(value), 4) as variance, round(min(value), 6) as "min", round(max(value), 6) as "max" from events group by 1
union all select event_type, 'user', count(user_id), round(avg(user_id), 6), round(var_samp(user_id), 4), min(user_id), max(user_id) from events group by 1""")
def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, variances and ends of events, added by three runs as states, one of them twice, and merged."""
    e = read(spark, sf_dir, "events")
    ledger = Ledger(spark, new_path(spark, "states"), ["event_type"], {"value": F.col("value"), "user": F.col("user_id")})
    for run, part in (("a", e.where("event_id % 5 = 0")), ("b", e.where("event_id % 5 in (1, 2)")), ("c", e.where("event_id % 5 > 2")), ("b", e.where("event_id % 5 in (1, 2)"))):
        ledger.add(run, part)
    out = ledger.values()
    return out.select("event_type", "metric", "count", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))
