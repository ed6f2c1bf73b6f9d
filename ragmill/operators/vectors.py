"""Exact vector search and late interaction for question sets of any size.

Vectors and questions meet in blocks of bounded size: a cell of the corpus is cut into chunks, the questions that visit it into blocks, and
each pair of the two is a group of its own. For the search, cells are those of pivots: a question first visits the nearest cells that hold
k vectors, whose k-th best score is a threshold; then it visits the cells that the triangle inequality can't rule out by that.

Sums run over the dimensions in order, so that a pair's score does not depend on what it is computed with, and equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored

#: Vectors of a chunk, questions of a block, and numbers of a table of scores that a task holds.
CHUNK, BLOCK, TABLE = 16384, 4096, 4 << 20
#: Most pivots, and vectors for each. Pivots are the one sample that the driver reads.
PIVOTS, PER_PIVOT = 256, 256
#: Distances between unit vectors are certain to this.
MARGIN = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products, each summed in the order of the dimensions."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.multiply.outer(a[:, d], b[:, d])
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * a[:, d]
    return np.sqrt(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _meet(corpus: DataFrame, asked: DataFrame, task: Callable, schema: str) -> DataFrame:
    """task(ids, labels, vectors, question ids, question vectors) for all pairs of a chunk and a block of one cell. corpus: cell, id, label,
    v; asked: cell, q, v. No group has more than about CHUNK vectors and BLOCK questions."""
    sizes = corpus.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "cell")
    sizes = F.broadcast(sizes)  # a row for each pivot at most
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = ["cell", "chunk", "block"]
    dealt = corpus.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), upto("blocks").alias("block"), "id", "label", "v")
    asking = asked.join(sizes, "cell").select("cell", upto("chunks").alias("chunk"), F.pmod(F.xxhash64("q"), "blocks").alias("block"), "q", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            left = left.slice(0, 0)
        left, right = left.combine_chunks(), right.combine_chunks()
        one = lambda t, name: t.column(name).combine_chunks() if t.num_rows else pa.array([], t.schema.field(name).type)
        q, questions = one(right, "q").to_numpy(zero_copy_only=False), _matrix(one(right, "v"))
        parts, step = [], max(1, TABLE // max(len(q), 1))
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step)
            parts.append(task(one(part, "id").to_numpy(zero_copy_only=False), one(part, "label").to_numpy(zero_copy_only=False), _matrix(one(part, "v")), q, questions))
        return pa.Table.from_batches(parts) if parts else empty

    empty = corpus.sparkSession.createDataFrame([], schema).toArrow()
    return dealt.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(run, schema)


_FOUND = "query_id long, passage_id long, score double"


def _best(k: int) -> Callable:
    def task(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, q: np.ndarray, questions: np.ndarray) -> pa.RecordBatch:
        with np.errstate(divide="ignore", invalid="ignore"):
            s = dots(questions, vectors) / (_norms(questions)[:, None] * _norms(vectors)[None])
        s[q[:, None] == ids[None]] = np.nan
        if s.shape[1] > k:
            least = -np.sort(-np.where(np.isnan(s), -np.inf, s), axis=1)[:, k - 1]
            i, j = np.nonzero(s >= least[:, None])
        else:
            i, j = np.nonzero(~np.isnan(s))
        by = np.lexsort((ids[j], -s[i, j], i))
        i, j = i[by], j[by]
        new = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        kept = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < k
        i, j = i[kept], j[kept]
        return pa.RecordBatch.from_arrays([pa.array(q[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s[i, j])], names=["query_id", "passage_id", "score"])

    return task


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "passage_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _units(v: np.ndarray) -> np.ndarray:
    return v / _norms(v)[:, None]


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction."""
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.where(F.col("v").isNotNull() & (square > 0) & ~F.isnan(square) & (square < float("inf")))


def top_by_cosine(queries: DataFrame, corpus: DataFrame, k: int, *, key: str = "vec_id", vector: str = "vec") -> DataFrame:
    """query_id, passage_id, score and rank 1 to k by exact cosine: ties by id, a vector never finds itself. Ids are not repeated; rows
    without a vector, or whose vector is zero or not finite, ask and answer nothing."""
    spark = corpus.sparkSession
    rows = _usable(corpus.select(F.col(key).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")))
    asked = _usable(queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // PER_PIVOT))).select("v").toArrow().column(0).combine_chunks()
    pivots = _units(_matrix(sample))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_units(_matrix(batch.column(2))), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns, pa.array(d[np.arange(len(cell)), cell])], names=["cell", "id", "label", "v", "d"])

    dealt = stored(rows.mapInArrow(assign, "cell long, id long, label long, v array<double>, d double"), "vectors-by-pivot")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()  # a row for each pivot at most
    counts, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for c in cells:
        counts[c["cell"]], radius[c["cell"]] = c["n"], c["r"]
    between = _distances(pivots, pivots)

    def near(d: np.ndarray) -> np.ndarray:
        """The nearest cells that hold k vectors besides the question's own."""
        order = np.argsort(d, axis=1, kind="stable")
        ahead = np.cumsum(counts[order], axis=1) - counts[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, ahead <= k, axis=1)
        return out & (counts > 0)

    def visits(second: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_units(_matrix(batch.column(1))), pivots)
                chosen = near(d)
                if second:
                    worst = np.sqrt(np.maximum(2 - 2 * batch.column(2).to_numpy(zero_copy_only=False), 0))  # NaN: fewer than k found
                    own = d.argmin(1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d**2 - d[np.arange(len(own)), own][:, None] ** 2) / (2 * between[own])
                    bound = np.fmax(d - radius, np.where(between[own] > 1e-3, plane, 0))  # pivots close by give no sure plane
                    chosen = ~chosen & (counts > 0) & ~(bound > worst[:, None] + MARGIN)
                i, c = np.nonzero(chosen)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "q", "v"])

        return run

    schema = "cell long, q long, v array<double>"
    first = stored(_meet(dealt, asked.mapInArrow(visits(False), schema), _best(k), _FOUND), "first-round")
    kth = _first(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), "score")
    again = asked.join(kth, "q", "left").select("q", "v", F.coalesce("score", F.lit(float("nan"))).alias("score"))
    more = _meet(dealt, again.mapInArrow(visits(True), schema), _best(k), _FOUND)
    return _first(first.unionByName(more), k).select("query_id", "passage_id", "score", "rank")


def max_sim(queries: DataFrame, corpus: DataFrame, *, key: str = "vec_id", vector: str = "vec", group: str = "label") -> DataFrame:
    """query_group, doc_group and score: late interaction of groups of vectors. For each vector of a question its best dot product with a
    document's vectors, summed; a document is all vectors of a group, wherever they are. A block gives one row for a vector of a question
    and a group."""
    schema = "query_id long, doc_group long, best double"

    def task(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, q: np.ndarray, questions: np.ndarray) -> pa.RecordBatch:
        s = dots(questions, vectors)
        groups = np.unique(labels)
        best = np.concatenate([s[:, labels == g].max(1) for g in groups])
        return pa.RecordBatch.from_arrays([pa.array(np.tile(q, len(groups)), pa.int64()), pa.array(np.repeat(groups, len(q)), pa.int64()), pa.array(best)], names=["query_id", "doc_group", "best"])

    one = F.lit(0).cast("long").alias("cell")
    v = F.col(vector).cast("array<double>").alias("v")
    rows = corpus.select(one, F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("label"), v).where("label is not null and v is not null")
    asked = queries.select(one, F.col(key).cast("long").alias("q"), v).where("v is not null")
    each = _meet(rows, asked, task, schema).groupBy("query_id", "doc_group").agg(F.max("best").alias("best"))
    named = queries.select(F.col(key).cast("long").alias("query_id"), F.col(group).alias("query_group"))
    return each.join(named, "query_id").groupBy("query_group", "doc_group").agg(F.sum("best").alias("score"))
