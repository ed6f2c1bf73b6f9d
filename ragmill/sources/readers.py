"""Sources: files of any supported format, registries of named data sets, experiment folders, histories.

All paths go through Spark's readers, so any store that Spark knows works. Nothing is read before it is used.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import seeded
from ..functions.text import parse_list, run_parameters

FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "orc": "orc", "arrow": "parquet", "txt": "text", "text": "text"}


def format_of(path: str) -> str:
    """By suffix; a path without one is a saved data set."""
    name = path.rstrip("/").rpartition("/")[2]
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    if suffix and suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}: {path}")
    return FORMATS.get(suffix, "parquet")


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't white space is a bracket; only the first lines are read."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(head) and head[0][0].lstrip().startswith("[")


def load(spark: SparkSession, path: str, fmt: str | None = None, *, schema: str | None = None, list_columns: Sequence[str] = (), names: Sequence[str] = (), index_column: bool = False, limit: int | None = None) -> DataFrame:
    """A table from a file or folder. JSON arrays and JSON lines are told apart; names makes a headerless CSV; index_column drops a
    CSV's first column; list_columns turn text into arrays; limit is the caller's cut."""
    fmt = fmt or format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        reader = reader.option("sep", "\t" if fmt == "tsv" else ",").option("multiLine", fmt == "csv").option("quote", '"').option("escape", '"')
        df = reader.option("header", not names).csv(path)
        df = df.toDF(*names) if names else df
    elif fmt in ("json", "jsonl"):
        df = reader.option("multiLine", fmt == "json" and is_json_array(spark, path)).json(path)
    elif fmt == "text":
        df = spark.read.text(path)
    else:
        df = reader.format(fmt).load(path)
    if index_column:
        df = df.drop(df.columns[0])
    for c in list_columns:
        df = df.withColumn(c, parse_list(F.col(c)))
    return df.limit(limit) if limit is not None else df


def text_of(spark: SparkSession, location: str) -> str:
    """One text from a file on any store, or from a URL."""
    if location.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(location) as answer:
            return answer.read().decode("utf-8")
    return spark.read.text(location, wholetext=True).first()[0]


def merged_json(spark: SparkSession, *paths: str) -> dict:
    """Objects of several JSON files as one, later ones win."""
    out: dict = {}
    for p in paths:
        out |= json.loads(text_of(spark, p))
    return out


def whole_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and value of each file below a folder."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """Paths and sizes of images; their bytes are read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def json_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json*").json(path)


@dataclass(frozen=True)
class Dataset:
    """An entry of a registry: where a data set is and which of its columns play which part."""

    path: str
    fmt: str | None = None
    folder: str | None = None
    subset: str | None = None
    split: str | None = None
    num_samples: int | None = None
    columns: Mapping[str, str] = field(default_factory=dict)  # part -> column


class Registry:
    """Named data sets from a JSON object or a file of one."""

    def __init__(self, entries: Mapping[str, Mapping | Dataset]):
        self.entries = {k: v if isinstance(v, Dataset) else Dataset(**v) for k, v in entries.items()}

    @classmethod
    def read(cls, spark: SparkSession, *paths: str) -> Registry:
        """Several files are merged, later ones win."""
        return cls(merged_json(spark, *paths))

    def table(self, spark: SparkSession, name: str, seed: int = 0) -> DataFrame:
        if name not in self.entries:
            raise KeyError(f"no data set {name}; there are {', '.join(sorted(self.entries))}")
        e = self.entries[name]
        if e.path.startswith("hub:"):
            raise ValueError(f"{e.path}: a hub's data sets must be copied to a store first")
        df = load(spark, "/".join(p for p in (e.path, e.folder, e.subset, e.split) if p), e.fmt)
        if e.columns:
            df = df.select(*[F.col(c).alias(part) for part, c in e.columns.items() if c in df.columns])
        if e.num_samples:
            df = df.orderBy(seeded(seed, F.to_json(F.struct(*df.columns)))).limit(e.num_samples)
        return df

    def tables(self, spark: SparkSession, names: Sequence[str]) -> dict[str, DataFrame]:
        return {n: self.table(spark, n) for n in names}


def choose_split(available: Sequence[str], preferred: str | None = None) -> str:
    """The preferred split, else test, validation, dev, train, else the first."""
    for s in (preferred, "test", "validation", "valid", "dev", "train"):
        if s in available:
            return s
    return next(iter(available))


def questions(df: DataFrame, image_base: str, take: int = -1, seed: int = 0) -> DataFrame:
    """Question rows with full image paths, and a seeded sample if asked for."""
    out = df.withColumn("img_path", F.concat(F.lit(image_base.rstrip("/") + "/"), F.col("img_path")))
    return out.orderBy(seeded(seed, F.col("question_id")), "question_id").limit(take) if take >= 0 else out


def passages(df: DataFrame, key: str = "passage_id", order: str | None = None) -> DataFrame:
    """One row for each passage id; of several the last by order wins."""
    if order is None:
        return df.select(key, "passage_content").dropDuplicates([key])
    return df.groupBy(key).agg(F.max_by("passage_content", order).alias("passage_content"))


def runs(spark: SparkSession, pattern: str, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> DataFrame:
    """Score files of experiment folders whose path has all of must and none of must_not, with the folder's parameters."""
    df = spark.read.json(pattern).withColumn("path", F.input_file_name())
    for m in must:
        df = df.where(F.contains("path", F.lit(m)))
    for m in must_not:
        df = df.where(~F.contains("path", F.lit(m)))
    folder = F.element_at(F.split("path", "/"), -2)
    return df.withColumn("run", folder).withColumn("parameters", run_parameters(folder))


def wide_summaries(texts: DataFrame) -> DataFrame:
    """path, task, score of summary tables: a row of task names, then a row of scores."""
    lines = F.split(F.trim("value"), r"\r?\n")
    cells = lambda i: F.split(F.get(lines, i), ",")
    rest = lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1)))
    pairs = F.arrays_zip(rest(cells(0)).alias("task"), rest(cells(1)).alias("score"))
    return texts.select("path", F.explode(pairs).alias("p")).select("path", F.trim("p.task").alias("task"), F.col("p.score").try_cast("double").alias("score")).where("score is not null")


def select_runs(found: DataFrame, *, ks: Sequence[int] = (), groups: Sequence[str] = (), names: Sequence[str] = (), scored: DataFrame | None = None) -> DataFrame:
    """Runs of any of the K values, of a group (a part of the name) or of an exact name; all without a choice. Those in scored (run)
    are left out."""
    wanted = [F.col("parameters.k").isin(list(ks))] if ks else []
    wanted += [F.contains("run", F.lit(g)) for g in groups] + ([F.col("run").isin(list(names))] if names else [])
    if wanted:
        test = wanted[0]
        for w in wanted[1:]:
            test = test | w
        found = found.where(F.coalesce(test, F.lit(False)))
    return found.join(scored.select("run"), "run", "left_anti") if scored is not None else found


def cached(df: DataFrame, cache: DataFrame, question_id: Column, query: Column) -> DataFrame:
    """Rows with their cache entry, met on the key `id-query`; null where the cache has none."""
    return df.withColumn("cache_key", F.trim(F.concat_ws("-", question_id, query))).join(cache, "cache_key", "left")


def history_cache(df: DataFrame, question_id: Column, query: Column, order: str) -> DataFrame:
    """cache_key of each history row, `id-query` trimmed; of equal keys the last wins."""
    keyed = df.withColumn("cache_key", F.trim(F.concat_ws("-", question_id, query)))
    rest = [c for c in keyed.columns if c != "cache_key"]
    return keyed.groupBy("cache_key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("cache_key", "r.*")


def turn_history(df: DataFrame, key: str, turns: str) -> DataFrame:
    """A row for each turn after the first with the response of the turn before: the query that retrieved it."""
    at = F.posexplode(F.col(turns)).alias("position", "turn")
    out = df.select(key, F.col(turns).alias("__t"), at).where("position > 0")
    return out.withColumn("previous", F.get("__t", F.col("position") - 1)).drop("__t")


def indexed(datasets: Mapping[str, DataFrame], order: Mapping[str, str]) -> DataFrame:
    """All rows of several data sets with their data set's name and a gapless row_id in it."""
    from ..operators.mixing import concatenate, running

    return concatenate({n: running(df.withColumn("__g", F.lit(0)), ["__g"], order[n], F.lit(1), "row_id").drop("__g") for n, df in datasets.items()})


def rows_at(df: DataFrame, which: int | slice | Sequence[int], *, row_id: str = "row_id") -> DataFrame:
    """Rows of a numbered table by index, slice or list (repeated ones as often as listed), with their place; negative indices count
    from the end. The rows are counted only if that is needed."""
    if isinstance(which, int):
        which = [which]
    if isinstance(which, slice):
        plain = all(x is None or x >= 0 for x in (which.start, which.stop)) and which.stop is not None and (which.step or 1) > 0
        start, stop, step = which.indices(which.stop if plain else df.count())
        low, high = (start, stop - 1) if step > 0 else (stop + 1, start)
        inside = F.col(row_id).between(low, high) & (F.pmod((F.col(row_id) - start) * (1 if step > 0 else -1), F.lit(abs(step))) == 0)
        return df.where(inside).withColumn("place", F.expr(f"({row_id} - {start}) div {step}"))
    n = df.count() if any(i < 0 for i in which) else 0
    wanted = df.sparkSession.createDataFrame([(k, i if i >= 0 else n + i) for k, i in enumerate(which)], f"place long, {row_id} long")
    return df.join(F.broadcast(wanted), row_id)  # the caller's list


def beam_logs(spark: SparkSession, path: str, parameters: DataFrame | None = None) -> DataFrame:
    """Beam records with context length and needle depth (a share) from the file's name, or from parameters (folder, context_length,
    depth), a sidecar's, where it has the file's folder."""
    df = spark.read.json(path).withColumn("path", F.input_file_name())
    part = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit("")).try_cast("int")
    df = df.withColumn("context_length", part(r"_len_(\d+)_")).withColumn("depth", part(r"_depth_(\d+)") / 100)
    if parameters is None:
        return df
    given = parameters.select("folder", F.col("context_length").alias("__c"), F.col("depth").alias("__d"))
    met = df.withColumn("folder", F.element_at(F.split("path", "/"), -2)).join(given, "folder", "left")
    return met.withColumn("context_length", F.coalesce("__c", "context_length")).withColumn("depth", F.coalesce("__d", "depth")).drop("__c", "__d", "folder")
