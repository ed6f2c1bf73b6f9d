"""Retrieval quality: ranks, reciprocal ranks, recall, and the joins between ranked lists, passages and gold ids.

A ranked list is an array of structs in rank order (passage_id, text, score, ...), or long rows of (question, rank, passage).
Ranks count from 1. Every aggregate is one pass over long rows with partial aggregation; lists are never gathered across questions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.arrays import argsort_desc

KS = (1, 3, 5, 10, 25, 50, 100)


# Ranked lists


def explode_ranked(df: DataFrame, lists: str, *, keep: Sequence[str]) -> DataFrame:
    """A row for each entry: keep, rank and the entry's fields."""
    return df.select(*keep, F.posexplode(lists).alias("__pos", "__p")).select(*keep, (F.col("__pos") + 1).alias("rank"), "__p.*")


def attach_text(ranked: DataFrame, passages: DataFrame, *, strict: bool = False) -> DataFrame:
    """Join passage texts by id. Of passages with one id the greatest text wins, so the join never multiplies rows. With strict an id
    that the passages lack fails the query; otherwise its text is null.

    Spark chooses to broadcast the passages only if they are small by its statistics.
    """
    one = passages.groupBy("passage_id").agg(F.max("passage_content").alias("passage_content"))
    met = ranked.join(one.withColumn("__there", F.lit(True)), "passage_id", "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no passage "), F.col("passage_id").cast("string")))
        met = met.where(F.when(F.col("__there"), True).otherwise(lost.cast("boolean")))
    return met.drop("__there")


def missing_passages(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """Ranked or gold ids that the passage table lacks; none in a sound data set."""
    return ranked.select("passage_id").distinct().join(passages, "passage_id", "left_anti")


def rerank(lists: Column, score: str = "rerank_score") -> Column:
    """A list by falling score; ties and nulls keep their order, nulls last."""
    keyed = F.transform(lists, lambda p, i: F.struct(p[score].isNull().alias("n"), (-p[score]).alias("s"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def batched_rerank(df: DataFrame, lists: str, size: int, score) -> DataFrame:
    """Lists scored in batches of so many entries, the last one smaller if need be, then ranked: entries get batch and rerank_score.
    score is a function of an entry's column."""
    scored = F.transform(lists, lambda p, i: p.withField("batch", F.floor(i / size)).withField("rerank_score", score(p)))
    return df.withColumn(lists, rerank(scored))


def retrieved(lists: Column, *, deduplicate: bool = False, k: int | None = None) -> Column:
    """A retriever's list under its options: without repeated texts, then cut."""
    out = deduplicated(lists) if deduplicate else lists
    return top(out, k) if k else out


def top(lists: Column, k: int) -> Column:
    return F.slice(lists, 1, k)


def deduplicated(lists: Column) -> Column:
    """First entry of each passage text."""
    texts = F.transform(lists, lambda p: p["text"])
    return F.filter(lists, lambda p, i: F.array_position(texts, p["text"]) == i + 1)


def ids_by_score(ids: Column, scores: Column) -> Column:
    """Passage ids by falling score; entries without a score (pruned branches) are left out."""
    return F.transform(argsort_desc(scores), lambda i: F.get(ids, i))


# Measures per question


def first_hit(ids: Column, gold: Column) -> Column:
    """Rank of the first retrieved id that is gold, null if none."""
    ranks = F.transform(ids, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.array_min(ranks)


def first_text_hit(texts: Column, answers: Column) -> Column:
    """Rank of the first text that contains an answer, null if none."""
    return F.array_min(F.transform(texts, lambda t, i: F.when(A.contains_any(t, answers), i + 1)))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def capped_rank(rank: Column, n: Column, *, cap: int = 50, missing: int = 100) -> Column:
    """A rank under the cap as it is; cap if the list reached it; missing if the list ended before."""
    return F.when(rank < cap, rank).when(n >= cap, F.lit(cap)).otherwise(F.lit(missing))


def overlap(ids: Column, gold: Column, k: int) -> Column:
    """Some of the first k ids is gold, compared as trimmed text; an empty list is a miss."""
    clean = lambda xs: F.transform(xs, lambda x: F.trim(x.cast("string")))
    return F.coalesce(F.arrays_overlap(F.slice(clean(ids), 1, k), clean(gold)), F.lit(False))


def title_in_gold(title: Column, gold: Column) -> Column:
    """The title is part of some gold id."""
    return F.exists(gold, lambda g: F.contains(g, title))


def document_in_gold(document: Column, gold: Column, *, equal: bool = False) -> Column:
    """The document, its line feeds at the end aside, is part of some gold document; with equal it is one."""
    d = F.regexp_replace(document, r"\n+$", "")
    return F.array_contains(gold, document) if equal else F.exists(gold, lambda g: F.contains(g, d))


def query_metrics(queries: Column) -> Column:
    """calls and mean_length (characters) of a question's queries; 0 without any."""
    n = F.size(queries)
    total = F.aggregate(queries, F.lit(0), lambda a, q: a + F.length(q))
    return F.struct(n.alias("calls"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("mean_length"))


# Reports


def mrr_and_recall(ranks: DataFrame, ks: Sequence[int] = KS, *, rank: str = "first_rank", by: Sequence[str] = ()) -> DataFrame:
    """Mean reciprocal rank, recall at each k and the count, over one row per question with its first hit's rank or null."""
    recalls = [F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))).alias(f"recall_at_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.avg(reciprocal(F.col(rank))).alias("mrr"), *recalls, F.count(F.lit(1)).alias("n_questions"))


def recall_long(ranks: DataFrame, ks: Sequence[int] = KS, *, rank: str = "first_rank") -> DataFrame:
    """k and recall as rows."""
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    hits = ranks.select(rank, k).groupBy("k")
    return hits.agg(F.avg(F.coalesce((F.col(rank) <= F.col("k")).cast("int"), F.lit(0))).alias("recall"))


def tolerant_recall(df: DataFrame, ids: str, gold: str, ks: Sequence[int]) -> DataFrame:
    """Recall with ids compared as text, empty lists as misses, and counts of rows, empty gold and empty retrieval."""
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    recalls = [F.avg(overlap(F.col(ids), F.col(gold), k).cast("int")).alias(f"recall_at_{k}") for k in ks]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty(F.col(gold))).alias("n_empty_gold"), F.count_if(empty(F.col(ids))).alias("n_empty_retrieval"), *recalls)


def duplicate_top(df: DataFrame, lists: str, k: int) -> DataFrame:
    """Questions whose first k texts repeat one, and all questions."""
    texts = F.transform(F.slice(lists, 1, k), lambda p: p["text"])
    return df.agg(F.count_if(F.size(F.array_distinct(texts)) < F.size(texts)).alias("n_with_duplicates"), F.count(F.lit(1)).alias("n_questions"))


def branch_report(df: DataFrame, k: int) -> DataFrame:
    """Hit rates of the prior's and the posterior's first passage, recall of both orders up to k, and the retrieval hit rate.

    Columns: gold_id, retrieved (ids), prior_sorted, posterior_sorted. Rows without retrieved ids are misses.
    """
    rate = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    out = [rate(F.array_contains("retrieved", F.col("gold_id"))).alias("retrieval_hit_rate")]
    for name in ("prior", "posterior"):
        ids = F.col(f"{name}_sorted")
        out.append(rate(F.get(ids, 0) == F.col("gold_id")).alias(f"{name}_hit_rate"))
        out += [rate(F.array_contains(F.slice(ids, 1, i), F.col("gold_id"))).alias(f"{name}_recall_at_{i}") for i in range(1, k + 1)]
    return df.agg(*out)
