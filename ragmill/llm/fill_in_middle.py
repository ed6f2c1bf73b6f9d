"""Fill-in-middle rows: a text is cut twice and its middle moved to the end, behind sentinels.

One Aho-Corasick automaton reads a text and finds the ASCII characters that belong to a class of their own and the sentinels. What lies
between two such events is of one class, so its number of units is arithmetic (its length over the width of its class, or one for a
class whose runs are units). Only places where the class changes are kept, with the units before each: a unit's place in the text is a
search among these events and a product. A text that holds a sentinel stays plain, so every output can be taken apart again.

Draws come from the SHA-256 of a seed and the decimal key: two cuts, plain or not, and the order of the pieces.

Defined results: a null text is an empty one and stays plain; a null key draws as the empty string; repeated rows draw alike and get a
row each; equal cuts give an empty middle; there are no ties; an empty table gives no rows; texts are read whole, however long; only the
key and the text are read, so other columns, whatever their names, have no effect and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

#: Prefix, suffix and middle are announced by these.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 draws, those from PLAIN_FROM on stay plain; of 100 others, those below SPM_BELOW have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Code points of an output batch: long texts leave in batches of few rows.
BATCH_POINTS = 16 << 20


@dataclass(frozen=True)
class Units:
    """classes: ASCII characters of class 1, 2, ...; all others are of class 0. widths: code points of a unit of each class, 0 where a
    maximal run is one unit."""

    classes: tuple[str, ...]
    widths: tuple[int, ...]


#: Code points; or words and the white space between them, so that no cut falls into a word.
UNITS = {"code_points": Units((WHITE,), (1, 1)), "words": Units((WHITE,), (0, 0))}


@cache
def automaton(units: Units, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """Values: the class of a character, or -1 for a sentinel."""
    out = ahocorasick.Automaton()
    for i, chars in enumerate(units.classes, 1):
        for c in chars:
            out.add_word(c, i)
    for s in sentinels:
        if s in out:
            raise ValueError(f"sentinel {s!r} is a character with a class of its own")
        out.add_word(s, -1)
    out.make_automaton()
    return out


class Ranks:
    """Places of a text's units, from the events of one scan."""

    def __init__(self, text: str, units: Units, sentinels: tuple[str, ...]) -> None:
        found = np.fromiter(chain.from_iterable(automaton(units, sentinels).iter(text)), np.int64).reshape(-1, 2)
        own = found[found[:, 1] > 0]
        self.marked = len(own) < len(found)
        # A class begins at each of its characters; class 0 begins behind one that no other event follows at once.
        after = own[:, 0] + 1
        gap = after < np.append(own[1:, 0], len(text))
        start = np.concatenate(([0], own[:, 0], after[gap]))
        kind = np.concatenate(([0], own[:, 1], np.zeros(gap.sum(), np.int64)))
        order = np.argsort(start, kind="stable")  # at 0, the character's class comes after the assumed one
        start, kind = start[order], kind[order]
        last = np.append(start[1:] != start[:-1], True)
        start, kind = start[last], kind[last]
        change = np.append(True, kind[1:] != kind[:-1])
        self.start, kind = start[change], kind[change]
        self.kind, self.width = kind, np.array(units.widths)[kind]
        self.length = len(text)
        size = np.diff(np.append(self.start, len(text)))
        own_units = np.where(self.width > 0, -(-size // np.maximum(self.width, 1)), np.minimum(size, 1))
        self.before = np.concatenate(([0], np.cumsum(own_units)))  # units before each event, then all
        self.n = int(self.before[-1])

    def place(self, unit: int) -> int:
        """The code point at which a unit begins; the text's length for the one behind the last."""
        if unit >= self.n:
            return self.length
        i = int(np.searchsorted(self.before, unit, "right")) - 1
        return int(self.start[i] + (unit - self.before[i]) * self.width[i])

    def inside_word(self, at: int) -> bool:
        """Does a cut before this code point part two characters of class 0?"""
        if not 0 < at < self.length:
            return False
        i = int(np.searchsorted(self.start, at, "right")) - 1
        return bool(self.kind[i] == 0 and self.start[i] < at)


def draws(key: object, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(key: object, text: str, units: Units, sentinels: tuple[str, str, str], seed: int, plain_from: int, spm_below: int) -> tuple:
    """(n, form, prefix code points, middle code points, whether either cut parts a word, output); nulls where plain."""
    ranks, (h1, h2, h3, h4) = Ranks(text, units, sentinels), draws(key, seed)
    if not text or ranks.marked or h3 % 100 >= plain_from:
        return ranks.n, "plain", None, None, None, text
    a, b = sorted(ranks.place(h % (ranks.n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    spm = h4 % 100 < spm_below
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return ranks.n, "spm" if spm else "psm", a, b - a, ranks.inside_word(a) or ranks.inside_word(b), out


def fill_in_middle(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    units: str = "code_points",
    sentinels: tuple[str, str, str] = SENTINELS,
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """key, n (units), form (plain, psm, spm), prefix_chars, middle_chars, splits_word and output, a row for each input row. Nothing is
    shuffled."""
    chosen = UNITS[units]
    if len(set(sentinels)) < 3 or any(a != b and a in b for a in sentinels for b in sentinels) or "" in sentinels:
        raise ValueError("sentinels must be three strings none of which contains another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

        def batch_of(keys: list, rows: list, kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], names=["__key", "n", "form", "prefix_chars", "middle_chars", "splits_word", "output"])

        for batch in batches:
            keys, rows, held = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                rows.append(transform(keys[-1], t.as_py() or "", chosen, sentinels, seed, plain_from, spm_below))
                held += len(rows[-1][-1])
                if held > BATCH_POINTS:
                    yield batch_of(keys, rows, batch.schema.field(0).type)
                    keys, rows, held = [], [], 0
            if rows:
                yield batch_of(keys, rows, batch.schema.field(0).type)

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"__key {kind}, n long, form string, prefix_chars long, middle_chars long, splits_word boolean, output string")
    return out.withColumnRenamed("__key", key)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, rebuilt from an output and its form alone."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(first: Column, second: Column) -> tuple[Column, Column, Column]:
        rest = F.split_part(output, second, F.lit(2))
        return F.split_part(F.split_part(output, second, F.lit(1)), first, F.lit(2)), F.split_part(rest, m, F.lit(1)), F.split_part(rest, m, F.lit(2))

    prefix, suffix, middle = between(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
