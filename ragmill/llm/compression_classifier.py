"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries hold labelled text, one for each label. A text is compressed with both; the difference of the sizes, as a
share of the text, tells which kind it is like. A logistic fit, cross-fitted on the labelled rows, turns this normalised
difference, and nothing else, into a probability, which thus rises or falls with it.

The fit uses a bounded sample: at most `rows` labelled documents of each label, chosen by hash, and of a document of more than
`most_bytes` bytes the blocks (BLOCK bytes each) that a hash picks from all over it; the labels' frequencies are counted over all
labelled rows that may be learnt from. Dictionaries are trained on the whole sample; of too little text for that they are
the text as it is, or segments that a hash picks from all over it. Scoring reads every text whole, in blocks of BLOCK bytes that are each compressed afresh, so
the dictionaries tell as much at the end of a text as at its start; labels, language, source and id are no inputs of a score.

Defined results: null and empty texts get one finite score, that of no difference; documents without a label are scored like
any other; repeated rows get a row each, and equal texts equal scores; labels that are null or neither 0 nor 1 are no labels, an id
with both labels is not learnt from, and of the texts of one id the one of the least hash is; with only one label to learn from
every score is that label's share; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_hash

ROWS = 2400
MOST_BYTES = 32_768
#: Bytes of a segment of a dictionary made of text as it is.
SEGMENT = 512
TRAINED_BYTES, PLAIN_BYTES = 112_640, 524_288
LEVEL = 3
#: Bytes that are compressed at once: beyond a few blocks a text's own history would take the dictionaries' place.
BLOCK = 16_384


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # for the difference, then the constant
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=_dictionary(d))
        self.good, self.bad = make(good), make(bad)

    def features(self, text: bytes) -> tuple[float]:
        """The difference of the compressed sizes (good text: above 0) as a share of the text."""
        if not text:
            return (0.0,)
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        g, b = (sum(len(c.compress(x)) for x in blocks) for c in (self.good, self.bad))
        return ((b - g) / len(text),)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"  # the format's magic number
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def plain_dictionary(samples: list[bytes]) -> bytes:
    """Text as it is: segments from all over the samples, in the order of their hashes, as many as it holds."""
    parts = {s[i : i + SEGMENT] for s in samples for i in range(0, len(s), SEGMENT)}
    order = sorted(parts, key=lambda p: hashlib.blake2b(p, digest_size=8).digest())
    return b"".join(order[: max(1, PLAIN_BYTES // SEGMENT)]) or b"\n"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """Segments that zstandard picks out; of too little text to train on, a plain one."""
    parts = [s[i : i + 4096] for s in samples for i in range(0, len(s), 4096)]
    try:
        return zstandard.train_dictionary(min(TRAINED_BYTES, max(1024, sum(map(len, parts)) // 8)), parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return plain_dictionary(samples)


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method. Both labels weigh the same in the fit; the constant is then moved to
    label 1's share of all labels."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += math.log(share / (1 - share))
    return w


def fit_rows(rows: list[tuple[bytes, int, int]], share: float | None = None) -> Model:
    """rows: text, label, hash. share: of label 1 among all labels, by default among the rows.

    The calibration is cross-fitted: each half of the rows (by hash) is measured with dictionaries of the other half, so no row is
    measured with its own text; the model's dictionaries are then built from all rows.
    """
    if share is None:
        share = (sum(y for _, y, _ in rows) + 1) / (len(rows) + 2)
    share = min(max(share, 1e-6), 1 - 1e-6)
    halves = [[(t, y) for t, y, h in rows if h % 2 == k] for k in (0, 1)]
    of = lambda rs, k: trained_dictionary([t for t, y in rs if t and y == k])
    every = halves[0] + halves[1]
    good, bad = of(every, 1), of(every, 0)
    y = np.array([y for _, y in every], float)
    if len(set(y)) < 2:
        return Model(good, bad, (0.0, math.log(share / (1 - share))), (0.0,), (1.0,))
    x = []
    for own, other in (halves, halves[::-1]):
        scorer = Scorer(of(other, 1), of(other, 0))
        x += [scorer.features(t) for t, _ in own]
    x = np.array(x)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - centre) / scale, y, share)
    return Model(good, bad, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)))


def _blocks_of(text: Column, key: Column, most_bytes: int) -> Column:
    """A text of up to most_bytes as it is; of a longer one so many blocks from all over it, those of the least hashes, in order."""
    n = F.floor((F.octet_length(text) + F.lit(BLOCK - 1)) / F.lit(BLOCK)).cast("int")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))))
    picked = F.array_sort(F.transform(F.slice(drawn, 1, max(1, most_bytes // BLOCK)), lambda x: x["i"]))
    empty = F.lit("").cast("binary")
    joined = F.aggregate(picked, empty, lambda whole, i: F.concat(whole, F.substring(text, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(joined)


def fit(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from labels that are not held out. The sample that reaches the driver is at most 2 * rows texts of most_bytes."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where(F.col("__key").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__key")))
    known = known.groupBy("__key").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").select("__key", "__y", F.xxhash64(F.lit("sample"), "__key").alias("__h"))
    picked = known.where("__y = 0").orderBy("__h", "__key").limit(rows).unionByName(known.where("__y = 1").orderBy("__h", "__key").limit(rows))
    docs = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("__text"), text_hash(F.col(text)).alias("__hash"))
    # Broadcast: at most 2 * rows ids.
    met = docs.join(F.broadcast(picked), "__key").select("__key", "__y", "__h", "__hash", _blocks_of(F.col("__text"), F.col("__key"), most_bytes).alias("__text"))
    got = met.groupBy("__key", "__y", "__h").agg(F.min(F.struct("__hash", "__text")).alias("__first")).collect()  # a text for each picked id
    n = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}  # two rows at most
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    return fit_rows(sorted((bytes(r["__first"]["__text"]), r["__y"], r["__h"] >> 7) for r in got), share)


def score_documents(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, difference (normalised) and score, a row for each input row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most PLAIN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.good, m.bad)
        for batch in batches:
            x = np.array([scorer.features(t.as_py() or b"") for t in batch.column(1)]).reshape(-1, 1)
            z = (x - m.centre) / m.scale @ np.array(m.weights[:-1]) + m.weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(score)], names=["__key", "difference", "score"])

    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, difference double, score double").withColumnRenamed("__key", key)
