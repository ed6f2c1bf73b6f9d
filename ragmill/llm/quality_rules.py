"""Quality rules as a ledger of failure bits. DataFrame functions only.

Each document is measured once; every rule is evaluated once from the measurements and sets one bit where it fails. A
policy is a named, versioned set of rules, so applying one is a bitwise and. Ablations need the bits alone: a document
that fails just one rule of a policy would be kept without it.

Defined results: a null text is measured as an empty one and so fails FEW_WORDS; empty texts the same; a null id is carried along;
repeated rows each get their own row; there are no ties, as rows are judged one by one; an empty table gives no rows; measures cover
whole texts, however long; only the id and the text are read, so other columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Words of a repeated window.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: Rules in the order of their bits. Each is true where a document fails. Add at the end only: ledgers keep the bits.
RULES: dict[str, str] = {
    "FEW_WORDS": "n_words < 10",
    "REPEATED_WINDOWS": "100 * n_repeat_words > 20 * n_words",
    "SYMBOLS": "100 * n_symbols > 20 * n_words",
    "SHOUTING": "100 * n_exclaims > 30 * n_words",
    "DUPLICATE_LINES": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "LONG_WORDS": "word_chars > 20 * n_words",
    "NO_LETTERS": "n_words > 0 and 2 * n_letters < word_chars",
}

#: Versioned policies. v1 is the base alone.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("FEW_WORDS", "REPEATED_WINDOWS"),
    "v2": ("FEW_WORDS", "REPEATED_WINDOWS", "SYMBOLS", "SHOUTING", "DUPLICATE_LINES", "LONG_WORDS", "NO_LETTERS"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")


def _covered(places: Column) -> Column:
    """Words that windows starting at the sorted places cover: each adds up to where the next one starts."""
    step = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(step, F.lit(0), lambda total, x: total + x)


def repeated_words(ws: Column) -> Column:
    """Words within the five-word windows that are found twice or more in ws. A window is told by a hash of its words' hashes: 64 bits."""

    def among(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(F.sort_array(F.transform(found, lambda x: x["i"])), _covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(at, twice))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashed = let(F.transform(ws, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(ws) > WINDOW, let(hashed, among)).otherwise(F.lit(0))


def measure(text: Column) -> Column:
    """A struct of all measures of a text, each of its parts computed once."""
    text = F.coalesce(text, F.lit(""))

    def of_words(t: Column, ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^ \t-\r]")))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
                (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long").alias("n_letters"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated_words(ws).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(text, lambda t: let(words(t), lambda ws: of_words(t, ws)))


def _bits(rule: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule(r), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(RULES.values())])


def fail_bits(measures: Column) -> Column:
    """One bit for each rule, in the order of RULES, from a struct that measure() gives; the struct is computed once."""
    return let(measures, lambda m: _bits(lambda rule: _with_fields(rule, m)))


def _with_fields(rule: str, m: Column) -> Column:
    """A rule over the fields of a struct: its SQL is small (numbers, measures, *, <, >, >=, and), so it is read term by term."""
    def term(x: str) -> Column:
        return reduce(lambda a, b: a * b, [F.lit(int(y)) if y.isdigit() else m[y] for y in x.split(" * ")])

    def test(x: str) -> Column:
        left, op, right = re.fullmatch(r"(.+) (<|>|>=) (.+)", x).groups()
        a, b = term(left), term(right)
        return a < b if op == "<" else a > b if op == ">" else a >= b

    return reduce(lambda a, b: a & b, [test(x) for x in rule.split(" and ")])


def ledger(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measures and fail_bits: one bit for each rule, in the order of RULES."""
    measured = df.select(F.col(key).alias("__key"), measure(F.col(text)).alias("__m")).select("__key", "__m.*")
    return measured.select(F.col("__key").alias(key), *MEASURES, _bits(F.expr).alias("fail_bits"))


def apply_policy(ledger_df: DataFrame, policy: str, *, bits: str = "fail_bits") -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return ledger_df.withColumn("kept", F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(ledger_df: DataFrame, policy: str, *, bits: str = "fail_bits") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (kept without it), and that are kept.

    The ledger is first counted by its bits, at most 2^rules rows, and the rest works on those counts.
    """
    by_bits = ledger_df.groupBy(F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = by_bits.select("__b", "__n", F.explode(rules).alias("__r"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0)).cast("long")
    hit = F.col("__b").bitwiseAND(F.col("__r.bit")) != 0
    return each.groupBy(F.col("__r.rule").alias("rule")).agg(
        count(hit).alias("n_failed"), count(F.col("__b") == F.col("__r.bit")).alias("n_kept_without"), count(F.col("__b") == 0).alias("n_kept")
    )
