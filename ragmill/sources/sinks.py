"""Sinks: tables, reports and logs that can be taken up again. Data is written by the executors; only reports of one row or a
stated few are formed on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import exists, remove, rename, stored


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Never overwrites unless told to; CSV and TSV have a header, JSON is one object a line."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer = writer.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",")
    writer.format({"jsonl": "json", "tsv": "csv"}.get(fmt, fmt)).save(path)


def save_json_array(df: DataFrame, path: str, *, order: tuple[str, ...] = (), indent: int | None = None) -> None:
    """One JSON array in one file, written row by row, so no task holds the table. The format has one writer; large tables go to JSON
    lines. order: columns that the rows are sorted by."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        yield pd.DataFrame({"value": ["["]})
        for pdf in frames:
            out = []
            for text in pdf["value"]:
                if held is not None:
                    out.append(held + ",")
                held = json.dumps(json.loads(text), indent=indent, ensure_ascii=False)
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ([held] if held is not None else []) + ["]"]})

    rows = df.orderBy(*order) if order else df
    rows = rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
    rows.mapInPandas(lines, "value string").write.text(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write df in the place of a table that it may be read from; the old table stays as path.backup. The new one is written beside
    it first, so a run that breaks off loses nothing."""
    spark, new, backup = df.sparkSession, f"{path}.new", f"{path}.backup"
    remove(spark, new)
    save(df, new, fmt)
    if exists(spark, path):
        remove(spark, backup)
        rename(spark, path, backup)
    rename(spark, new, path)


def save_splits(splits: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in splits.items():
        save(df, f"{path}/{name}", fmt)


def save_variants(df: DataFrame, variant: str, path: str) -> DataFrame:
    """One folder for each variant, and the manifest: variant and rows."""
    df.write.partitionBy(variant).json(f"{path}/data")
    manifest = df.groupBy(variant).agg(F.count(F.lit(1)).alias("n_rows"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def append_unfinished(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> int:
    """Append the rows whose key the log at path lacks; returns how many. A run that broke off can so be started again."""
    spark = df.sparkSession
    try:
        done = spark.read.format(fmt).load(path).select(key)
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = df.select(key).limit(0)
    todo = stored(df.join(done, key, "left_anti"), "unfinished")  # so the log is read once, and what is counted is what is appended
    todo.write.mode("append").format(fmt).save(path)
    return todo.count()


def report_json(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report_text(df: DataFrame, template: str, path: str, *columns: str) -> None:
    """A line of text for each row, by a printf template."""
    df.select(F.format_string(template, *[F.col(c) for c in columns])).coalesce(1).write.mode("overwrite").text(path)


def table_text(df: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """A report as a table for the console: markdown, grid or csv. `most` bounds what reaches the driver; a longer one is an error."""
    rows, names = df.limit(most + 1).collect(), df.columns
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for the console")
    cells = [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    if style == "csv":
        return "\n".join(",".join(f'"{c}"' if "," in c else c for c in r) for r in [names, *cells])
    wide = [max(len(r[i]) for r in [names, *cells]) for i in range(len(names))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |"
    if style == "grid":
        rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
        return "\n".join([rule, line(names), rule.replace("-", "="), *[x for r in cells for x in (line(r), rule)]])
    rule = "|" + "|".join("-" * (w + 2) for w in wide) + "|"
    return "\n".join([line(names), rule, *map(line, cells)])
