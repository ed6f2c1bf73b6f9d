"""Queries over sources and sinks: each writes tables to the shared folder in some format and reads them again."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as X
from ..operators import analytics as N
from ..operators import curation as C
from ..sources import readers, sinks
from ..sources.folders import new_path
from ..sources.json_lines import json_lines
from ..streaming.streams import run_available
from .base import query, read


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


@query("""select f as format, c_custkey::bigint c_custkey, c_name, c_acctbal, c_mktsegment || '|' || c_nationkey as tags, 2::bigint as n_tags from customer, (select unnest(['csv', 'jsonl', 'orc', 'parquet', 'tsv']) f)""")
def load_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers saved and loaded in each format; lists leave as text for CSV and TSV and are lists again when loaded."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    base, out = new_path(spark, "formats"), []
    for fmt in ("csv", "tsv", "jsonl", "parquet", "orc"):
        plain = fmt in ("csv", "tsv")
        sinks.save(c.withColumn("tags", F.to_json("tags")) if plain else c, f"{base}/t.{fmt}", fmt)
        df = readers.load(spark, f"{base}/t.{fmt}", list_columns=("tags",) if plain else ())
        out.append(df.select(F.lit(fmt).alias("format"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.array_join("tags", "|").alias("tags"), F.size("tags").cast("long").alias("n_tags")))
    return _union(out)


@query("""select k as kind, k = 'array' is_array, s_suppkey::bigint s_suppkey, s_name from supplier, (select unnest(['array', 'lines', 'streamed']) k)""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a pretty JSON array, a plain one that is streamed out, and as lines with blank ones between; the first character
    tells the reader which."""
    s, base = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), new_path(spark, "arrays")
    sinks.save_json_array(s, f"{base}/array.json", order=("s_suppkey",), indent=2)
    sinks.save_json_array(s, f"{base}/streamed.json")
    s.select(F.concat(F.to_json(F.struct("*")), F.lit("\n\n")).alias("value")).write.text(f"{base}/lines.json")
    tables = [readers.load(spark, f"{base}/{k}.json").select(F.lit(k).alias("kind"), F.lit(k != "streamed" and readers.is_json_array(spark, f"{base}/{k}.json")).alias("is_array"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name") for k in ("array", "lines", "streamed")]
    return _union(tables)


@query("""select o_orderkey::bigint o_orderkey, o_orderstatus from orders""")
def json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines beside files of another kind, which are left out."""
    o, path = read(spark, sf_dir, "orders"), new_path(spark, "folder")
    o.select("o_orderkey", "o_orderstatus").write.json(path)
    o.select("o_orderstatus").limit(3).write.mode("append").text(path)
    return readers.json_folder(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")


@query("""select event_id::bigint event_id, event_type, round(value, 4) as value from events""")
def jsonl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, read as a stream of byte ranges and drained."""
    path = new_path(spark, "jsonl")
    read(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    out = run_available(json_lines(spark, path, "event_id long, event_type string, value double", stream=True, range_bytes=1 << 20), "jsonl")
    return out.withColumn("value", F.round("value", 4))


@query("""select user_id::bigint user_id, count(*) n from events group by 1""")
def jsonl_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user out of a folder of JSON lines that is cut into ranges of 64 KB."""
    path = new_path(spark, "jsonl")
    read(spark, sf_dir, "events").select("user_id").write.json(path)
    return json_lines(spark, path, "user_id long", range_bytes=1 << 16).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'nations' as _dataset_name, n_nationkey::bigint as id, n_name as label, (row_number() over (order by n_nationkey) - 1)::bigint row_id, 'validation' as split from nation
union all select 'parties', s_suppkey, s_name, row_number() over (order by s_suppkey) - 1, 'validation' from supplier""")
def registry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets named by two registry files, the second of which replaces an entry of the first; columns take the parts they play, and
    rows are numbered within their data set. A split that isn't there falls back."""
    base = new_path(spark, "registry")
    _text(spark, json.dumps({"nations": {"path": f"{sf_dir}/nation.parquet", "fmt": "parquet", "columns": {"id": "n_nationkey", "label": "n_name"}}, "parties": {"path": f"{sf_dir}/region.parquet", "fmt": "parquet"}}), f"{base}/first")
    _text(spark, json.dumps({"parties": {"path": f"{sf_dir}/supplier.parquet", "fmt": "parquet", "columns": {"id": "s_suppkey", "label": "s_name"}}}), f"{base}/second")
    tables = readers.Registry.read(spark, f"{base}/first", f"{base}/second").tables(spark, ["nations", "parties"])
    out = readers.indexed({k: t.withColumn("id", F.col("id").cast("long")) for k, t in tables.items()}, {k: "id" for k in tables})
    return out.select("_dataset_name", "id", "label", F.col("row_id").cast("long").alias("row_id"), F.lit(readers.choose_split(["train", "validation"], "test")).alias("split"))


@query("""with r as (select c_custkey, row_number() over (order by c_custkey) - 1 i, count(*) over () n from customer)
select 'slice' as access, ((i - 10) // 3)::bigint place, c_custkey::bigint c_custkey from r where i >= 10 and i < 100 and (i - 10) % 3 = 0
union all select 'reversed', n - 1 - i, c_custkey from r where i >= n - 5
union all select 'list', p, c_custkey from r join (values (0, 7), (1, 3), (2, 7)) t(p, j) on i = j
union all select 'last', 0, c_custkey from r where i = n - 1""")
def row_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a numbered table by slice, reversed slice, list and negative index."""
    rows = readers.indexed({"c": read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))}, {"c": "c_custkey"})
    kinds = {"slice": slice(10, 100, 3), "reversed": slice(None, -6, -1), "list": [7, 3, 7], "last": -1}
    return _union([readers.rows_at(rows, which).select(F.lit(k).alias("access"), F.col("place").cast("long").alias("place"), "c_custkey") for k, which in kinds.items()])


@query("""with s as (select left(o_orderpriority, 1) model, (o_orderkey % 3 + 1) * 4096 seq_len, o_orderstatus task, round(avg(o_totalprice), 2) score from orders group by all)
select model, seq_len::int seq_len, round(avg(score), 4) mean_score, min(score) filter (where task like 'F%') least_of_prefix, count(*) n_tasks from s group by all""")
def summary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary files of two lines, task names and scores, in folders by model and length: mean over the tasks, and least over those of
    a name prefix."""
    o, path = read(spark, sf_dir, "orders"), new_path(spark, "summaries")
    s = o.groupBy(F.left("o_orderpriority", F.lit(1)).alias("model"), ((F.col("o_orderkey") % 3 + 1) * 4096).alias("len"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    g = s.groupBy("model", "len").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "score"))).alias("p"))
    line = lambda head, c: F.concat_ws(",", F.lit(head), F.transform("p", lambda x: x[c].cast("string")))
    g.select("model", "len", F.concat(line("Tasks", "o_orderstatus"), F.lit("\n"), line("Score", "score")).alias("value")).write.partitionBy("model", "len").text(path)
    found = readers.wide_summaries(readers.whole_texts(spark, path, "part-*"))
    part = lambda p: F.regexp_extract("path", p, 1)
    rows = found.select(part("model=([^/]+)/").alias("model"), part(r"len=(\d+)/").cast("int").alias("seq_len"), "task", "score")
    out = N.task_scores(rows, ["model", "seq_len"], "F")
    return out.withColumn("mean_score", F.round("mean_score", 4))


@query("""with s as (select 'Exp-K=' || (c_nationkey % 4 * 5) || '-TakeN=10-TopK=50' || case when c_nationkey % 2 = 0 then '-TopP=0.9' else '' end run, (c_nationkey % 4 * 5)::int k, count(*) n from customer group by all)
select run, k, 10 as take_n, 50 as top_k, case when k % 2 = 0 then 0.9::double else 1.0 end top_p, n, row_number() over (order by k) as place from s where k in (5, 10) or run like '%K=15%'""")
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files of experiment folders: paths must have one part and lack another, a choice by K and by name, finished ones left out,
    parameters read from the folder's name, rows in the order of the parameters that are there."""
    c, base = read(spark, sf_dir, "customer"), new_path(spark, "runs")
    for i in range(4):
        name = f"Exp-K={5 * i}-TakeN=10-TopK=50" + ("-TopP=0.9" if i % 2 == 0 else "")
        c.where(F.col("c_nationkey") % 4 == i).agg(F.count(F.lit(1)).alias("n")).write.json(f"{base}/{name}")
    c.agg(F.count(F.lit(1)).alias("n")).write.json(f"{base}/Exp-debug-K=5")
    c.agg(F.count(F.lit(1)).alias("n")).write.json(f"{base}/Other-K=5")
    found = readers.runs(spark, f"{base}/*", must=("Exp",), must_not=("debug",))
    scored = found.where("parameters.k = 0").select("run")
    out = readers.select_runs(found, ks=(0, 5, 10), groups=("K=15",), scored=scored).select("run", "parameters.*", "n")
    return N.placed(out, ["k", "missing", "top_k", "top_p"])


@query("""with h as (select 'q' || o_custkey || '-' || o_orderpriority as cache_key, o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc) r from orders)
select c_custkey::bigint c_custkey, p as priority, o_orderkey::bigint o_orderkey from customer, (select unnest(['1-URGENT', '5-LOW']) p) left join h on r = 1 and cache_key = 'q' || c_custkey || '-' || p""")
def history_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a query history: the last of equal questions is kept, and rows meet it on the composite key."""
    history = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").cast("long").alias("o_orderkey"))
    key = F.concat(F.lit("q"), F.col("o_custkey").cast("string"))
    cache = readers.history_cache(history, key, F.col("o_orderpriority"), "o_orderkey").select("cache_key", "o_orderkey")
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("priority"))
    return readers.cached(asked, cache, F.concat(F.lit("q"), F.col("c_custkey").cast("string")), F.col("priority")).select("c_custkey", "priority", "o_orderkey")


@query("""select 'txt' as suffix, sum(octet_length(encode(c_name)) + 1)::bigint n_bytes from customer union all select 'whole', octet_length(encode(r_name)) + 1 from region
union all select 'one', 5""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files listed by suffix with their sizes (other files left out), read whole, and one read as one value."""
    base = new_path(spark, "texts")
    read(spark, sf_dir, "customer").select("c_name").write.text(f"{base}/a")
    read(spark, sf_dir, "customer").select("c_name").write.json(f"{base}/b")
    listed = readers.images(spark, base, "*.txt").agg(F.sum("length").alias("n_bytes")).select(F.lit("txt").alias("suffix"), "n_bytes")
    r = read(spark, sf_dir, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("k"))
    r.repartition(5, "k").write.partitionBy("k").text(f"{base}/c")
    whole = readers.whole_texts(spark, f"{base}/c", "*.txt").select(F.lit("whole").alias("suffix"), F.octet_length("value").cast("long").alias("n_bytes"))
    _text(spark, "four", f"{base}/d")
    return _union([listed, whole, spark.createDataFrame([("one", len(readers.text_of(spark, f"{base}/d")))], "suffix string, n_bytes long")])


@query("""with e as (select event_id, user_id % 2 g, user_id % 5 seg, value from events),
b as (select g, seg, event_id beam, value alpha, row_number() over (partition by g, seg order by value desc, event_id) r from e)
select case when g = 0 then 4096 else 8192 end::int context_length, case when g = 0 then 0.25 else 0.5 end::double depth, case when g = 0 then 2 else 4 end::int gold_chunk, seg::bigint segment, beam::bigint beam, alpha from b where r = 1""")
def beam_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam logs whose context length and needle depth come from the folder's name or from a sidecar; the best beam of each segment, and
    the chunk that holds the needle at that depth of nine."""
    e, base = read(spark, sf_dir, "events"), new_path(spark, "beams")
    beams = e.select((F.col("user_id") % 2).alias("g"), (F.col("user_id") % 5).alias("segment"), F.col("event_id").alias("beam"), F.col("value").alias("alpha"))
    beams.where("g = 0").drop("g").write.json(f"{base}/log_len_4096_depth_25")
    beams.where("g = 1").drop("g").write.json(f"{base}/plain")
    sidecar = spark.createDataFrame([("plain", 8192, 0.5)], "folder string, context_length int, depth double")
    rows = readers.beam_logs(spark, f"{base}/*", sidecar).select("context_length", "depth", "segment", "beam", "alpha")
    best = N.best_per(rows, ["context_length", "depth", "segment"], "alpha", "beam")
    return best.select("context_length", "depth", X.gold_chunk(F.col("depth") * 100, F.lit(9)).alias("gold_chunk"), "segment", "beam", "alpha")


@query("""select r_regionkey::int as id, r_name || chr(10) || 'A. ' || r_name || 'a' || chr(10) || 'B. x, "y"' || chr(10) || 'Answer:' || case when r_regionkey % 2 = 0 then 'A' else 'B' end prompt from region""")
def multiple_choice_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless CSV with assigned names, and one whose leading index column is dropped; each row as a prompt of lettered choices."""
    r, base = read(spark, sf_dir, "region"), new_path(spark, "choices")
    rows = r.select("r_regionkey", F.col("r_name").alias("question"), F.concat("r_name", F.lit("a")).alias("A"), F.lit('x, "y"').alias("B"), F.when(F.col("r_regionkey") % 2 == 0, "A").otherwise("B").alias("answer"))
    rows.write.option("quoteAll", True).option("escape", '"').csv(f"{base}/plain.csv")
    named = readers.load(spark, f"{base}/plain.csv", names=("id", "question", "A", "B", "answer"))
    sinks.save(named.select(F.lit(0).alias("index"), "*"), f"{base}/indexed.csv", "csv")
    t = readers.load(spark, f"{base}/indexed.csv", index_column=True)
    return t.select(F.col("id").cast("int").alias("id"), C.multiple_choice(F.col("question"), F.array("A", "B"), F.col("answer")).alias("prompt"))


@query("""select 'manifest' as part, lang as variant, count(*) n from documents group by lang union all select 'data', lang, count(*) from documents group by lang
union all select 'report', 'all', count(*) from documents union all select 'line', lang, count(*) from documents group by lang""")
def saved_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each variant with a manifest of its rows, a report of one object, and a text report of a line for each group."""
    d, base = read(spark, sf_dir, "documents").select("doc_id", "lang"), new_path(spark, "reports")
    sinks.save_variants(d, "lang", f"{base}/variants")
    manifest = spark.read.json(f"{base}/variants/manifest").select(F.lit("manifest").alias("part"), F.col("lang").alias("variant"), F.col("n_rows").alias("n"))
    data = spark.read.json(f"{base}/variants/data").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit("data").alias("part"), F.col("lang").alias("variant"), "n")
    sinks.report_json(d.agg(F.count(F.lit(1)).alias("n")), f"{base}/report")
    report = spark.read.json(f"{base}/report").select(F.lit("report").alias("part"), F.lit("all").alias("variant"), "n")
    sinks.report_text(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "%s: %d", f"{base}/text", "lang", "n")
    parts = F.split("value", ": ")
    line = spark.read.text(f"{base}/text").select(F.lit("line").alias("part"), parts[0].alias("variant"), parts[1].cast("long").alias("n"))
    return _union([manifest, data, report, line])


@query("""select s as style, i::int as line, case s when 'csv' then case i when 0 then 'k,name' else (i - 1) || ',' || n end
 when 'markdown' then case i when 0 then '| k | name        |' when 1 then '|---|-------------|' else '| ' || (i - 2) || ' | ' || rpad(n, 11, ' ') || ' |' end
 else case when i = 1 then '| k | name        |' when i = 2 then '+===+=============+' when i % 2 = 0 then '+---+-------------+' else '| ' || (i - 3) // 2 || ' | ' || rpad(n, 11, ' ') || ' |' end end as value
from (select s, i, n from (values ('csv', 6), ('markdown', 7), ('grid', 13)) t(s, c), range(13) r(i) left join (select r_regionkey k, r_name n from region) on k = case s when 'csv' then i - 1 when 'markdown' then i - 2 else case when i % 2 = 1 then (i - 3) // 2 else -1 end end where i < c)""")
def console_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small report as a table for the console in each style, line by line."""
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).orderBy("k")
    lines = [(s, i, x) for s in ("csv", "markdown", "grid") for i, x in enumerate(sinks.table_text(r, s).split("\n"))]
    return spark.createDataFrame(lines, "style string, line int, value string")


@query("""select 'now' as version, c_custkey::bigint c_custkey, 2 * c_acctbal as balance from customer union all select 'backup', c_custkey, c_acctbal from customer""")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table changed in its place; what it was stays beside it."""
    path = f"{new_path(spark, 'replaced')}/t"
    sinks.save(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").alias("balance")), path)
    old = spark.read.parquet(path)
    sinks.replace_table(old.withColumn("balance", 2 * F.col("balance")), path)
    return _union([spark.read.parquet(p).select(F.lit(v).alias("version"), "c_custkey", "balance") for v, p in (("now", path), ("backup", f"{path}.backup"))])


@query("""select c_custkey::bigint c_custkey, 1::bigint as n_logged, (select count(*) from customer where c_custkey % 3 = 0) first_run, (select count(*) from customer where c_custkey % 3 != 0) second_run from customer""")
def resumed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that breaks off after a third of the rows and is taken up again: nothing is logged twice."""
    c, path = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey")), f"{new_path(spark, 'log')}/t"
    first = sinks.append_unfinished(c.where("c_custkey % 3 = 0"), path, "c_custkey")
    second = sinks.append_unfinished(c, path, "c_custkey")
    return spark.read.parquet(path).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_logged")).select("*", F.lit(first).cast("long").alias("first_run"), F.lit(second).cast("long").alias("second_run"))


@query("""select split, doc_id::bigint doc_id from (select case when doc_id % 10 = 0 then 'validation' else 'train' end split, doc_id from documents)""")
def saved_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation rows saved as a data set of two folders and loaded by name."""
    d, path = read(spark, sf_dir, "documents").select("doc_id"), new_path(spark, "splits")
    sinks.save_splits({"train": d.where("doc_id % 10 != 0"), "validation": d.where("doc_id % 10 = 0")}, path)
    return _union([readers.load(spark, f"{path}/{s}").select(F.lit(s).alias("split"), F.col("doc_id").cast("long").alias("doc_id")) for s in ("train", "validation")])
