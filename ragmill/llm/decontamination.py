"""Benchmark decontamination by size-partitioned MinHash containment.

A test item is a set of five-word shingles. A document contains it if it holds 0.8 or more of them. Items are partitioned by
size (powers of two); each partition is an index of its own, whose parameter, the sketch length, follows from its largest size
u: the u // 5 + 1 least hashes of an item under one MinHash order, or all it has, are its bottom sketch. A containing document
misses at most n // 5 of an item's n shingles, so it holds all but n // 5 of the sketch's k keys at least, which are one or
more. What holds that many keys is a candidate; thus the containment estimate of the sketch is used as an exact bound: no
containing document is missed, however long. Candidates are verified by exact containment of the shingles' words. Documents
are not sketched: every shingle of theirs is looked up.

Documents meet items in shuffled joins, whatever the sizes of both. A bitmap of fixed size, made of the items' hashes, keeps
shingles that no item has from leaving a document's task; one that is full keeps none and changes no result.

Words are lower-case, split at ASCII white space, with ASCII punctuation stripped from their ends; words of punctuation alone
are dropped. Defined results: null and empty texts contain nothing; items with fewer than five words have no shingle and match
nothing; texts are read whole, however long; repeated items and repeated documents get a row each, null ids are ids like any
other; ties need no order; empty tables give no rows; only ids and texts are read, so other columns have no effect.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import bitmap, in_bitmap
from .common import shared_table, text_hash, without_rows

SHINGLE = 5
#: Containment, as a fraction: 4 of 5.
SHARE = (4, 5)
_WHITE = " \t\n\x0b\x0c\r"
_TABLE = {ord(c): " " for c in _WHITE}
#: White space to str.split() that isn't ASCII white space.
_ODD = re.compile(r"[^\S \t\n\x0b\x0c\r]")


def words(text: str) -> list[str]:
    return [w for w in (x.strip(string.punctuation) for x in _split(text.lower())) if w]


def _split(text: str) -> list[str]:
    """At ASCII white space only; str.split() knows more."""
    return text.translate(_TABLE).split(" ") if _ODD.search(text) else text.split()


def _hashes(ws: list[str]) -> np.ndarray:
    """A 64-bit hash for each five-word shingle, in order."""
    if len(ws) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(ws, dtype=object), categorize=False)
    out = h[: len(h) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - SHINGLE + 1 + i]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def size_class(n: int) -> int:
    """The largest size of the partition that an item of n shingles is in."""
    return 1 << max(0, (n - 1).bit_length())


def sketch_length(n: int) -> int:
    """Keys of an item of n shingles: by its size partition, never more than n."""
    return min(n, size_class(n) * (SHARE[1] - SHARE[0]) // SHARE[1] + 1)


def least_keys(n: int) -> int:
    """Sketch keys that a document which contains the item holds at least."""
    return sketch_length(n) - n * (SHARE[1] - SHARE[0]) // SHARE[1]


def _item_shingles(items: DataFrame, kind: str) -> DataFrame:
    """item_id, __ih, h, s (the shingle), n (shingles of the item), k (sketch keys that a document needs, on sketch keys alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(2)):
                ws = words(x.as_py() or "")
                h, first = np.unique(_hashes(ws), return_index=True)
                n = len(h)
                if n:
                    take = pa.array(np.full(n, i))
                    text = pa.array([" ".join(ws[j : j + SHINGLE]) for j in first.tolist()])
                    keys = pa.array(np.full(n, least_keys(n)), mask=np.arange(n) >= sketch_length(n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), text, pa.array(np.full(n, n)), keys], names=["item_id", "__ih", "h", "s", "n", "k"])

    return items.select("__key", "__hash", "__text").mapInArrow(run, f"item_id {kind}, __ih long, h long, s string, n long, k long")


def _document_shingles(docs: DataFrame, kind: str, known: Broadcast) -> DataFrame:
    """__key, __hash, h, s: the distinct shingles of each document that the bitmap of the items' hashes lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, texts = [], [], []
            for i, x in enumerate(batch.column(2)):
                ws = words(x.as_py() or "")
                own = _hashes(ws)
                places = np.flatnonzero(in_bitmap(own, known.value))
                h, first = np.unique(own[places], return_index=True)
                at += [i] * len(h)
                hashes.append(h)
                texts += [" ".join(ws[j : j + SHINGLE]) for j in places[first].tolist()]
            take = pa.array(at, pa.int64())
            found = pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), found, pa.array(texts, pa.string())], names=["__key", "__hash", "h", "s"])

    return docs.select("__key", "__hash", "__text").mapInArrow(run, f"__key {kind}, __hash long, h long, s string")


def _contained(df: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """Sketch keys name candidate pairs, whose distinct shared shingles are then counted.

    Ids are met null-safely. Pairs are decided once for rows alike; the rows are then joined back, so that repeated ones get theirs.
    """
    docs, items = _keyed(df, key, text), _keyed(benchmark, item_key, item_text)
    kinds = [t.schema["__key"].dataType.simpleString() for t in (docs, items)]
    i = shared_table(_item_shingles(items, kinds[1]).distinct(), "item-shingles")
    known = df.sparkSession.sparkContext.broadcast(bitmap(i, "h"))
    d = shared_table(_document_shingles(docs, kinds[0], known), "document-shingles")
    met = d.join(i.where("k is not null"), ["h", "s"]).select("__key", "__hash", "item_id", "__ih", "n", "k", "h").distinct()
    pairs = met.groupBy("__key", "__hash", "item_id", "__ih", "n", "k").agg(F.count(F.lit(1)).alias("held")).where("held >= k").drop("held", "k")
    own = _null_safe(pairs, i.select("item_id", "__ih", "h", "s"), "item_id", "__ih")
    hit = _null_safe(own, d, "__key", "__hash", "h", "s").distinct()
    hit = hit.groupBy("__key", "__hash", "item_id", "__ih", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    hit = hit.where(F.col("n_shared") * SHARE[1] >= F.col("n") * SHARE[0])
    hit = _null_safe(hit, items.select(F.col("__key").alias("item_id"), F.col("__hash").alias("__ih")), "item_id", "__ih")
    return _null_safe(hit, docs.select("__key", "__hash"), "__key", "__hash").select("__key", "__hash", "item_id", F.col("n").alias("n_shingles"), "n_shared")


def _null_safe(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """The inner join on columns in which nulls are equal."""
    right = right.select(*[F.col(c).alias(f"__right_{c}" if c in on else c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition &= F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return left.join(right, condition).drop(*[f"__right_{c}" for c in on])


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.col(text).alias("__text"))


def find_contamination(df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, n_shingles of the item and n_shared: all pairs of a document and an item that it contains."""
    return _contained(df, benchmark, key, text, item_key, item_text).drop("__hash").withColumnRenamed("__key", key)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the documents that contain an item. Their keys are written, then met in an anti join."""
    found = _contained(df, benchmark, key, text, item_key, item_text).select("__key", "__hash").distinct()
    return without_rows(df, shared_table(found, "contaminated"), key=key, text=text)
