"""Which of a set of patterns each document holds as a substring; both sides may be large.

Texts meet patterns by q-grams. A pattern is indexed by one of its grams, the one that the fewest texts have; the texts' grams are shuffled
to it, copies of a text once, and `contains` decides. Of long patterns and of texts only minimizers are grams: the least of each WINDOW
neighbouring hashes, which are the same inside a pattern and where the pattern stands in a text. Shorter patterns take shorter grams
(CLASSES), of which texts give all. A pattern with a gram that no text has is nowhere.

Grams that no pattern has leave a text's task as little as a bitmap of fixed size can see to that. The driver reads the bitmap and which
classes are in use, no pattern and no text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import stored


class Class(NamedTuple):
    """Patterns of at least so many code points, up to the next class; their grams' length, and the neighbours of which the least counts."""

    shortest: int
    gram: int
    window: int


CLASSES = (Class(16, 8, 9), Class(4, 4, 1), Class(1, 1, 1), Class(0, 0, 1))
#: Bits of the bitmap of pattern grams (8 MB), and code points that are hashed at once.
BITS, CHUNK = 1 << 26, 1 << 20


def grams(texts: Sequence[str], kind: Class) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, their grams of a class as signed 64-bit hashes), repeats included, about CHUNK code points at a time. The empty
    pattern's gram is in every text."""
    q, w = kind.gram, kind.window
    if q == 0:
        yield np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):  # neighbouring pieces of a long text share what a window reaches over
            owners.append(i)
            pieces.append(text[at : at + CHUNK + q + w - 2])
            held += len(pieces[-1])
            if held >= CHUNK:
                yield _hashed(owners, pieces, q, w)
                owners, pieces, held = [], [], 0
    if pieces:
        yield _hashed(owners, pieces, q, w)


def _hashed(owners: list[int], pieces: list[str], q: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces at once: windows that begin in one and end in the next are left out."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes) - q - w + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n + w - 1, q, np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = h[:n].copy()
    for j in range(1, w):
        np.minimum(least, h[j : j + n], out=least)
    lengths = np.array([len(x) for x in pieces])
    inside = np.arange(n) + q + w - 1 <= np.repeat(np.cumsum(lengths), lengths)[:n]
    return np.repeat(np.array(owners), lengths)[:n][inside], least[inside].view(np.int64)


def class_of(n: int) -> Class:
    return next(c for c in CLASSES if n >= c.shortest)


def _each(rows: DataFrame, classes: Sequence[Class] | None, known=None) -> DataFrame:
    """key, gram from key, text: grams of these classes that the bitmap knows, or without classes those of the text's own class. A long
    text may give a gram once for each of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for kind in CLASSES if classes is None else classes:
                chosen = [i for i, t in enumerate(texts) if classes is not None or class_of(len(t)) == kind]
                for owner, own in grams([texts[i] for i in chosen], kind):
                    if known:
                        kept = in_bitmap(own, known.value)
                        owner, own = owner[kept], own[kept]
                    by = np.lexsort((own, owner))
                    owner, own = owner[by], own[by]
                    new = np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])) if len(own) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[np.array(chosen)[owner[new]]] if new.any() else keys[:0]), pa.array(own[new])], names=["key", "gram"])

    return rows.mapInArrow(run, "key long, gram long")


def bitmap(hashes: DataFrame, column: str = "gram") -> bytes:
    """BITS bits, one set for each hash: of fixed size, however many there are."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    bits = hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    return out.tobytes()


def in_bitmap(hashes: np.ndarray, bits: bytes) -> np.ndarray:
    """Which of the hashes may be among those that the bitmap was made of."""
    at = hashes.view(np.uint64) & np.uint64(BITS - 1)
    return (np.frombuffer(bits, np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def contained(docs: DataFrame, patterns: DataFrame, *, keep: Sequence[str], text: str, item: str, pattern: str) -> DataFrame:
    """keep and item for each document and each pattern that its text contains, an empty one too; null texts and patterns match nothing.
    Letters count as they are: fold both sides beforehand."""
    spark = docs.sparkSession
    items = patterns.select(F.col(item).alias("__item"), F.col(pattern).alias("__p"), F.xxhash64(pattern).alias("__ph")).where("__p is not null")
    rows = docs.select(*keep, F.col(text).alias("__t"), F.xxhash64(text).alias("__th")).where("__t is not null")
    size = F.length("__p")
    used = items.agg(*[F.max((size >= c.shortest) & (size < above.shortest if above else F.lit(True))) for c, above in zip(CLASSES, [None, *CLASSES], strict=False)]).first()
    classes = [c for c, u in zip(CLASSES, used, strict=True) if u]
    pattern_grams = stored(_each(items.select(F.col("__ph").alias("key"), "__p"), None).distinct(), "pattern-grams")
    known = spark.sparkContext.broadcast(bitmap(pattern_grams))
    text_grams = stored(_each(rows.select(F.col("__th").alias("key"), "__t"), classes, known), "text-grams")

    counts = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    index = pattern_grams.join(counts, "gram", "left").groupBy(F.col("key").alias("__ph")).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
    met = text_grams.join(index.where("absent = 0"), "gram").select(F.col("key").alias("__th"), "__ph").distinct()
    found = rows.join(met, "__th").join(items, "__ph").where(F.contains("__t", "__p"))
    return found.select(*keep, F.col("__item").alias(item))
