"""Numeric array functions: log-space mixtures, late interaction, token budgets, masks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def logsumexp(xs: Column) -> Column:
    return let(xs, lambda v: let(F.array_max(v), lambda m: m + F.ln(total(F.transform(v, lambda x: F.exp(x - m))))))


def softmax(xs: Column) -> Column:
    """Shifted by the maximum; [] stays []."""
    shifted = lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(let(xs, shifted), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(xs: Column) -> Column:
    return let(xs, lambda v: let(logsumexp(v), lambda z: F.transform(v, lambda x: x - z)))


def prior(mode: str, logits: Column) -> Column:
    """Log scores of the branches: log_softmax and head read the logits, uniform is 0.0 for each."""
    if mode == "uniform":
        return F.transform(logits, lambda x: F.lit(0.0))
    return log_softmax(logits) if mode == "log_softmax" else logits


def entropy(ps: Column) -> Column:
    """In nats; zero shares are skipped."""
    return F.aggregate(ps, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: over query vectors, the sum of the best dot product with a document vector."""
    return total(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))))


def argsort_desc(xs: Column) -> Column:
    """Indices from 0 by falling value, nulls left out, ties by index."""
    pairs = F.filter(F.transform(xs, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))), lambda p: p["x"].isNotNull())
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def sequence_budget(source: Column, target: Column, cutoff: int) -> Column:
    """Lengths of source and target under a cutoff: the shorter side is spared if it is under half, else both shrink in proportion."""
    most = F.when(target * 2 < cutoff, F.lit(cutoff)).when(source * 2 < cutoff, cutoff - source).otherwise(F.floor(F.lit(cutoff) * (target / (source + target))).cast("int"))

    def lengths(t: Column) -> Column:
        return F.struct(F.least(F.greatest(cutoff - t, F.lit(0)), source).alias("source"), t.alias("target"))

    return let(F.least(most, target), lengths)


def mask_labels(source: Column, target: Column, ignore: int = -100) -> Column:
    return F.concat(F.array_repeat(F.lit(ignore), F.size(source)), target)


def pair_encoding(prompt: Column, chosen: Column, rejected: Column, cutoff: int, ignore: int = -100) -> Column:
    """ids and labels of a prompt with a chosen and with a rejected answer under a cutoff, which the longer answer's length shares out."""

    def encode(n: Column) -> Column:
        cut = lambda xs, k: F.slice(xs, F.lit(1), k)
        p = cut(prompt, n["source"])
        sides = []
        for name, answer in (("chosen", chosen), ("rejected", rejected)):
            a = cut(answer, n["target"])
            sides += [F.concat(p, a).alias(f"{name}_ids"), mask_labels(p, a, ignore).alias(f"{name}_labels")]
        return F.struct(*sides)

    return let(sequence_budget(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff), encode)


def binary_encoding(prompt: Column, answer: Column, desirable: Column, cutoff: int, ignore: int = -100) -> Column:
    """ids, labels and tag of a prompt with an answer that is wanted or not."""

    def encode(n: Column) -> Column:
        p, a = F.slice(prompt, F.lit(1), n["source"]), F.slice(answer, F.lit(1), n["target"])
        return F.struct(F.concat(p, a).alias("ids"), mask_labels(p, a, ignore).alias("labels"), desirable.alias("tag"))

    return let(sequence_budget(F.size(prompt), F.size(answer), cutoff), encode)


def rendered(messages: Column, ignore: int = -100) -> Column:
    """ids, labels and loss_weights of a conversation: messages are structs of ids (tokens) and loss_weight; tokens without weight are
    ignored as labels."""
    weights = F.flatten(F.transform(messages, lambda m: F.transform(m["ids"], lambda _: m["loss_weight"].cast("double"))))
    labels = F.flatten(F.transform(messages, lambda m: F.transform(m["ids"], lambda t: F.when(m["loss_weight"] > 1e-6, t).otherwise(F.lit(ignore)))))
    return F.struct(F.flatten(F.transform(messages, lambda m: m["ids"])).alias("ids"), labels.alias("labels"), weights.alias("loss_weights"))


def pad(xs: Column, n: Column | int, value: int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(xs, F.array_repeat(F.lit(value), F.greatest(n - F.size(xs), F.lit(0)))), F.lit(1), n)


def valid_gold(indices: Column, n: Column) -> Column:
    return F.filter(indices, lambda i: (i >= 0) & (i < n))


def gold_chunk(depth_percent: Column, n: Column) -> Column:
    """Index of the chunk at a depth: round(d / 100 * (n - 1)), half to even, at most the last."""
    return F.least(F.bround(depth_percent / 100 * (n - 1)), n - 1).cast("int")


def resolve_index(i: Column, n: Column) -> Column:
    """A negative index counts from the end; null if out of range."""
    j = F.when(i < 0, n + i).otherwise(i)
    return F.when((j >= 0) & (j < n), j)


def swap(xs: Column, a: Column, b: Column) -> Column:
    """Elements a and b (from 0) trade places."""
    return F.transform(xs, lambda x, i: F.when(i == a, F.get(xs, b)).when(i == b, F.get(xs, a)).otherwise(x))


def common_prefix(arrays: Column) -> Column:
    """The longest common prefix of an array of arrays."""
    n = F.array_min(F.transform(arrays, F.size))
    first = F.get(arrays, 0)
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.exists(arrays, lambda x: F.get(x, i) != F.get(first, i)))
    return F.when(n > 0, F.slice(first, F.lit(1), F.coalesce(F.try_element_at(differ, F.lit(1)), n))).otherwise(F.slice(first, 1, 0))


def chunked(xs: Column, n: int) -> Column:
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(n)), lambda i: F.slice(xs, i, n))).otherwise(F.slice(F.array(xs), 1, 0))


def count_at_least(xs: Column, value: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x >= value))


def min_p(logits: Column, share: float) -> Column:
    """Logits whose probability is under a share of the best one's become null."""
    return let(logits, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.when(F.exp(x - m) >= share, x))))


def penalized(logits: Column, counts: Column, *, repetition: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> Column:
    """Repetition divides positive and multiplies negative logits of seen tokens; frequency and presence subtract."""

    def one(x: Column, c: Column) -> Column:
        y = F.when((c > 0) & (x > 0), x / repetition).when(c > 0, x * repetition).otherwise(x)
        return y - frequency * c - F.when(c > 0, presence).otherwise(0.0)

    return F.zip_with(logits, counts, one)


def held_back(logits: Column, end: Column, generated: Column, least: int) -> Column:
    """Logits whose end token (an index) is null until so many tokens are there."""
    return F.transform(logits, lambda x, i: F.when((i != end) | (generated >= least), x))


def biased(logits: Column, bias: Column) -> Column:
    """Logits with a map from token to what is added to it."""
    return F.transform(logits, lambda x, i: x + F.coalesce(F.try_element_at(bias, i), F.lit(0.0)))


def ends_with(tokens: Column, suffix: Column) -> Column:
    """Whether a token sequence ends in another: the test for multi-token bad words."""
    n = F.size(suffix)
    return (F.size(tokens) >= n) & (F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n) == suffix)


def cyclic_slice(xs: Column, start: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(xs, F.pmod(start + j, F.size(xs)).cast("int")))


def interior_points(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced points between two ends, rounded half to even, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.bround(low + (high - low) * i / F.lit(n + 1.0)))))


def continuation_tokens(offsets: Column, at: Column) -> Column:
    """Token spans (start, end) that reach beyond a character place, the one that straddles it included."""
    return F.filter(offsets, lambda o: o["end"] > at)


def proposal(tokens: Sequence, low: int, high: int, k: int) -> Sequence:
    """Up to k tokens that followed the earliest earlier place of the longest suffix of low to high tokens; none if there is no such place.

    The last tokens, backwards, are a pattern that is looked for in the others, backwards, by its failure function: linear time, whatever
    the suffix's length.
    """
    pattern, n = list(tokens[::-1][:high]), len(tokens)
    fail, state = [0] * len(pattern), 0
    for i in range(1, len(pattern)):
        while state and pattern[i] != pattern[state]:
            state = fail[state - 1]
        state += pattern[i] == pattern[state]
        fail[i] = state
    state, best, at = 0, 0, None
    for i in range(n - 2, -1, -1):
        while state and (state == len(pattern) or pattern[state] != tokens[i]):
            state = fail[state - 1]
        state += pattern[state] == tokens[i]
        if state and state >= best:
            best, at = state, i
    return tokens[at + best : at + best + k] if at is not None and best >= low else tokens[:0]


def propose_by_ngram(tokens: Column, low: int, high: int, k: int, kind: str = "array<int>", longest: int | None = None) -> Column:
    """proposal() for arrays of a kind; longest bounds the tokens and what is proposed together."""

    def each(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else list(proposal(list(x), low, high, k if longest is None else max(0, min(k, longest - len(x))))) for x in arrays])

    return F.pandas_udf(each, kind)(tokens)
