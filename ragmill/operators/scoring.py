"""Text similarity scores: BLEU and ROUGE, as corpus sums of n-gram counts and as a row function."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.text import words


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))).otherwise(F.slice(tokens, 1, 0))


def clipped(prediction: Column, reference: Column) -> Column:
    """How many of the prediction's n-grams the reference has, each at most as often as it has it."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    kinds = F.array_distinct(F.array_intersect(prediction, reference))
    return F.aggregate(F.transform(kinds, lambda x: F.least(count(prediction, x), count(reference, x))), F.lit(0), lambda a, v: a + v)


def corpus_bleu(df: DataFrame, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """BLEU of a corpus, 0 to 100, from one aggregate of clipped n-gram counts; 0 if some order has no match."""
    rows = df.select(words(F.col(prediction)).alias("p"), words(F.col(reference)).alias("r"))
    parts = []
    for n in range(1, order + 1):
        parts += [F.sum(clipped(ngrams(F.col("p"), n), ngrams(F.col("r"), n))).alias(f"m{n}"), F.sum(F.size(ngrams(F.col("p"), n))).alias(f"t{n}")]
    sums = rows.agg(*parts, F.sum(F.size("p")).alias("pl"), F.sum(F.size("r")).alias("rl"))
    log_p = sum((F.ln(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    brevity = F.when(F.col("pl") < F.col("rl"), F.exp(1 - F.col("rl") / F.col("pl"))).otherwise(1.0)
    possible = F.least(*[F.col(f"m{n}") for n in range(1, order + 1)]) > 0
    return sums.select(F.when(possible, 100 * brevity * F.exp(log_p)).otherwise(0.0).alias("bleu"))


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    """F1 of shared n-grams."""

    def score(x: Column) -> Column:
        m = clipped(x["p"], x["r"])
        return F.coalesce(F.try_divide(2.0 * m, F.size(x["p"]) + F.size(x["r"])), F.lit(0.0))

    return let(F.struct(ngrams(words(prediction), n).alias("p"), ngrams(words(reference), n).alias("r")), score)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words: one row of the table is folded over the prediction's words."""

    def lcs(x: Column) -> Column:
        def next_row(row: Column, w: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                up, diagonal = F.get(row, j), F.get(row, j - 1)
                left = F.get(acc, j - 1)
                return F.concat(acc, F.array(F.when(F.get(x["r"], j - 1) == w, diagonal + 1).otherwise(F.greatest(up, left))))

            return F.aggregate(F.sequence(F.lit(1), F.size(x["r"])), F.array(F.lit(0)), cell)

        last = F.aggregate(x["p"], F.array_repeat(F.lit(0), F.size(x["r"]) + 1), next_row)
        m = F.get(last, F.size(x["r"]))
        return F.when((F.size(x["p"]) == 0) | (F.size(x["r"]) == 0), 0.0).otherwise(2.0 * m / (F.size(x["p"]) + F.size(x["r"])))

    return let(F.struct(words(prediction).alias("p"), words(reference).alias("r")), lcs)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number."""
    at, full = {}, (1 << len(a)) - 1
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge(p: Column, r: Column) -> Column:
    """rouge1, rouge2 and rougeL (F1) of two lists of words of any length, as a struct; row by row over Arrow batches."""

    def one(a: list[str], b: list[str]) -> tuple[float, ...]:
        out = []
        for n in (1, 2):
            x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (a, b))
            total = sum(x.values()) + sum(y.values())
            out.append(2.0 * sum((x & y).values()) / total if total else 0.0)
        return *out, 2.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0

    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(list(x), list(y)) for x, y in zip(p, r, strict=True)], columns=["rouge1", "rouge2", "rougeL"])

    return F.pandas_udf(score, "rouge1 double, rouge2 double, rougeL double")(p, r)


def sentence_bleu(order: int = 4) -> Callable:
    """A vectorised function of (prediction, reference): smoothed sentence BLEU, 0 to 1."""

    def one(p: str | None, r: str | None) -> float:
        a, b = (p or "").split(), (r or "").split()
        if not a or not b:
            return 0.0
        total = 0.0
        for n in range(1, order + 1):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
            total += math.log((sum((x & y).values()) + (n > 1)) / (max(1, sum(x.values())) + (n > 1)) or 1e-9)
        return min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(total / order)

    def bleu(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(p, r, strict=True)])

    return F.pandas_udf(bleu, "double")


def pluggable(scorer: Callable[[str, list[str], str], float], on_error: float = 0.0) -> Callable:
    """A vectorised function of (question, references, candidate) around any Python scorer; its errors give on_error."""

    def score(q: pd.Series, refs: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for x, y, z in zip(q, refs, c, strict=True):
            try:
                out.append(float(scorer(x, list(y) if y is not None else [], z)))
            except Exception:  # any scorer's errors have a stated value
                out.append(on_error)
        return pd.Series(out)

    return F.pandas_udf(score, "double")
