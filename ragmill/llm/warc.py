"""WARC archives: a writer on Spark's own file committer, and a reader that salvages what damage has left.

Writer: one gzip member for each record, so that a damaged one costs no other. Payloads seen before become revisit records.
Spark has no binary sink, so members go through the text sink: a member ends in the high byte of its size, which is zero
below 16 MiB (an empty member follows a larger one), and that byte is written as the sink's line separator. A row of the sink is
a whole file of about FILE_BYTES. Files are thus plain .warc.gz streams, committed as any Spark output, and a lost executor
costs a retry.

Reader: takes plain and gzipped archives. Where a member, a header, a length or a digest fails its check, the reader looks for
the next valid member or version line, goes on there, and logs the bytes between as a quarantined gap. Where a member inflates
but holds a damaged record, only the inflated bytes between the records that hold up are logged, by their offsets in it.

Defined results: a null payload is an empty one; a null id or URL leaves its header out and is read back as null; repeated rows get a
record each, all of them responses if theirs is the least id, and between equal payloads of one id there is no first; an empty
table writes no records; an empty archive gives no records and no gap, a wholly damaged one no records and one gap for its bytes;
payloads are written and read whole, a long one as a file of its own; a member that inflates to more than any row's value can hold is
quarantined; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table

#: Payloads below this size are never revisits.
LEAST = 100
#: Bytes after which a file is closed.
FILE_BYTES = 8 << 20
#: Beyond this a member holds more than a value of a row can (2 GiB) and its headers: no record that a row could give or take.
MOST_INFLATED = (1 << 31) + (1 << 20)
#: Parts that a digest's pages are dealt to where they meet the digest's first page.
SALTS = 16

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "urn:page:"
_EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")


# Writing


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean}"] if clean is not None else []),
        *([f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose last byte is zero."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file: members up to FILE_BYTES or one that is longer, without the last byte."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for i, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(member(record(i, u, p or b"", d, r)))
            size += len(held[-1])
            if size >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])


def with_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """__id, __url, __payload (binary), __digest and __refers: the least id with an equal payload, if it is another's."""
    p = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), p.alias("__payload"))
    rows = rows.withColumn("__digest", F.sha2("__payload", 256)).withColumn("__long", F.octet_length("__payload") >= LEAST)
    firsts = rows.where("__long").groupBy("__digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null")
    firsts = shared_table(firsts.select(F.col("__digest").alias("__d"), "__first"), "firsts")
    salted = firsts.select("__d", "__first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    salt = F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")
    met = rows.join(salted.hint("merge"), (F.col("__digest") == F.col("__d")) & (salt == F.col("__s")) & F.col("__long"), "left")
    return met.select("__id", "__url", "__payload", "__digest", F.when(~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first")).alias("__refers"))


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for each row as .warc.gz archives (files named part-*) under path."""
    rows = with_revisits(pages, key=key, url=url, payload=payload)
    files = rows.mapInArrow(_files, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


# Reading


def _inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The member that starts at a place, and where it ends; None if it is damaged or too large."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof:
            part = z.unconsumed_tail
            if not part:
                if pos >= len(data):
                    return None
                part = data[pos : pos + 65536]
                pos += 65536
            out.append(z.decompress(part, 1 << 20))
            size += len(out[-1])
            if size > MOST_INFLATED:
                return None
    except zlib.error:
        return None
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that starts at a place, checked, and where it ends; None if a check fails."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0 or not data.startswith(_VERSION, at):
        return None
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    end = head + 4 + int(length)
    block = data[head + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return None
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    found = hashlib.sha256(payload).hexdigest()
    if kind != "revisit" and digest.startswith("sha256:") and digest[7:] != found:
        return None
    return {"fields": fields, "type": kind, "payload": payload, "digest": digest[7:] if kind == "revisit" and digest else found}, end + 4


class Gap(NamedTuple):
    """Quarantined bytes of an archive, or, if the member from start to end inflates, of what it inflates to."""

    start: int
    end: int
    inner_start: int | None = None
    inner_end: int | None = None


def _plain(data: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) all through a plain stream; a record of None is a gap."""
    at = 0
    while at < len(data):
        one = _parse(data, at)
        if one:
            end = one[1]
        else:
            nearest = _LINE.search(data, at + 1)
            end = nearest.start() if nearest else len(data)
        yield at, end, one and one[0]
        at = end


def ledger(data: bytes) -> tuple[list[tuple[int, dict]], list[Gap]]:
    """(offset, record) of all records that hold up, and the gaps between them, in order, merged where they touch."""
    view, at, records, gaps = memoryview(data), 0, [], []

    def quarantine(gap: Gap) -> None:
        if gaps and gap.inner_start is None and gaps[-1].inner_start is None and gaps[-1].end == gap.start:
            gaps[-1] = Gap(gaps[-1].start, gap.end)
        elif gaps and gaps[-1][:2] == gap[:2] and gaps[-1].inner_end == gap.inner_start is not None:
            gaps[-1] = gaps[-1]._replace(inner_end=gap.inner_end)
        else:
            gaps.append(gap)

    while at < len(data):
        end = None
        if data.startswith(_MAGIC, at):
            if got := _inflate(view, at):
                end = got[1]
                for a, b, one in _plain(got[0]):
                    if one:
                        records.append((at, one))
                    else:
                        quarantine(Gap(at, end, a, b))
        elif one := _parse(data, at):
            records.append((at, one[0]))
            end = one[1]
        if end is None:
            nearest = _NEXT.search(data, at + 1)
            end = nearest.start() if nearest else len(data)
            quarantine(Gap(at, end))
        at = end
    return records, gaps


def salvage(data: bytes) -> tuple[list[tuple[int, dict]], list[tuple[int, int]]]:
    """ledger() with the gaps as (start, end) in the archive: of a member with lost records inside, the member's."""
    records, gaps = ledger(data)
    return records, list(dict.fromkeys(g[:2] for g in gaps))


def _page(value: str) -> int | None:
    found = re.search(rf"{_URN}(-?[0-9]+)>", value)
    return int(found[1]) if found else None


_READ = {"path": pa.string(), "start": pa.int64(), "end": pa.int64(), "inner_start": pa.int64(), "inner_end": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            records, gaps = ledger(data.as_py() or b"")
            rows = [(path, *g, *(None,) * 7) for g in gaps]
            for at, r in records:
                f, revisit = r["fields"], r["type"] == "revisit"
                n = f.get("warc-payload-length", "")
                size = int(n) if revisit and n.isascii() and n.isdigit() else len(r["payload"])
                refers = _page(f.get("warc-refers-to", "")) if revisit else None
                rows.append((path, at, None, None, None, _page(f.get("warc-record-id", "")), f.get("warc-target-uri"), r["type"], None if revisit else r["payload"], size, r["digest"], refers))
            for i in range(0, len(rows), 1000):
                columns = zip(*rows[i : i + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.values(), strict=True)], names=list(_READ))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under path: start is the offset in the file; gaps alone have an end, and no record_type."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, "path string, start long, end long, inner_start long, inner_end long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
