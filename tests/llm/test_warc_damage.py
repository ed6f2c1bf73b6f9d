"""Damaged archives: through Spark, and byte by byte; files are rolled by bytes."""

from __future__ import annotations

import glob
import hashlib

import pytest

from ragmill.llm import warc
from ragmill.llm.common import new_path


def one(i, text=b"some page "):
    payload = text * 30 + str(i).encode()
    return warc.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None)


def ids(records):
    return [warc._page(r["fields"].get("warc-record-id", "")) for _, r in records]


def test_gaps_inside_a_member():
    a, b, c = one(1), one(2), one(3)
    broken = b[:-20] + b"XXXX" + b[-16:]
    data = warc.member(a) + warc.member(a + b"bad" + c + broken + b) + warc.member(c)
    records, gaps = warc.ledger(data)
    assert ids(records) == [1, 1, 3, 2, 3]
    at, end = len(warc.member(a)), len(data) - len(warc.member(c))
    inner = len(a) + 3 + len(c)
    assert gaps == [warc.Gap(at, end, len(a), len(a) + 3), warc.Gap(at, end, inner, inner + len(broken))]


def test_every_byte_is_a_record_or_a_gap():
    """Each single damaged byte costs one record at most, and the gap is where it is."""
    plain = [one(i, b"q") for i in range(3)]
    for parts in (plain, [warc.member(p) for p in plain]):
        whole = b"".join(parts)
        for at in range(0, len(whole), 7):
            data = bytearray(whole)
            data[at] ^= 0xFF
            records, gaps = warc.ledger(bytes(data))
            k = next(k for k in range(3) if at < sum(map(len, parts[: k + 1])))
            others = [i for i in range(3) if i != k]
            assert [i for i in ids(records) if i in others] == others
            if len(records) == 2:
                assert gaps and all(g.start <= g.end <= len(data) for g in gaps)
                assert any(g.start <= at < g.end for g in gaps)


def test_too_large_a_member_is_quarantined(monkeypatch):
    monkeypatch.setattr(warc, "MOST_INFLATED", 1 << 18)
    big = warc.record(1, "u", b"z" * (1 << 20), hashlib.sha256(b"z" * (1 << 20)).hexdigest(), None)
    data = warc.member(one(0)) + warc.member(big) + warc.member(one(2))
    records, gaps = warc.ledger(data)
    assert ids(records) == [0, 2] and len(gaps) == 1


def test_damage_through_spark(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i} " + "text of the page " * (i % 40)) for i in range(500)]
    path = new_path(spark, "test-damage")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path)
    files = sorted(glob.glob(path.removeprefix("file://") + "/part-*"))
    with open(files[0], "rb") as f:
        data = f.read()
    starts = [at for at, _ in warc.ledger(data)[0]]
    hit = starts[10] + 25
    with open(files[0], "wb") as f:
        f.write(data[:hit] + bytes([data[hit] ^ 0x55]) + data[hit + 1 :])
    import os

    for crc in glob.glob(os.path.dirname(files[0]) + "/.*.crc"):
        os.remove(crc)
    rows = warc.read_warc(spark, path).collect()
    gaps = [r for r in rows if r["record_type"] is None]
    assert len(rows) - len(gaps) == 499 and [(r["start"], r["end"], r["inner_start"]) for r in gaps] == [(starts[10], starts[11], None)]


@pytest.mark.parametrize("size", [1, 5000, 8 << 20])
def test_files_are_rolled_by_bytes(spark, size, monkeypatch):
    pages = [(1, "u", "x" * 300_000), (2, "u", None)] + [(i, f"u{i}", f"page {i}" * 50) for i in range(3, 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "test-roll")
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    rows = [(p[0], p[1], (p[2] or "").encode()) for p in pages]
    made = list(warc._files(iter([__import__("pyarrow").RecordBatch.from_pydict({"i": [r[0] for r in rows], "u": [r[1] for r in rows], "p": [r[2] for r in rows], "d": [hashlib.sha256(r[2]).hexdigest() for r in rows], "r": [None] * len(rows)})])))
    assert sum(len(ids(warc.ledger(m.column(0)[0].as_py() + b"\0")[0])) for m in made) == len(pages)
    assert len(made) == {1: 59, 8 << 20: 1}.get(size, len(made)) and all(not warc.ledger(m.column(0)[0].as_py() + b"\0")[1] for m in made)
    warc.write_warc(df, path)
    assert sorted(r["page_id"] for r in warc.read_warc(spark, path).collect()) == list(range(1, 60))
