"""The byte-range source: every cut gives every line once, streams go on at their offsets."""

from __future__ import annotations

import io
import json

import pytest

from ragmill.sources.json_lines import json_lines, last_feed, lines_of, written
from ragmill.streaming import streams

TEXTS = [b"", b"\n", b"a", b"a\n", b"\n\na\n\nbc\n", b'{"a": 1}\n\n{"a": "\xc3\xa9"}\r\n{"a": 3}', b"x" * 50 + b"\n" + b"y" * 3 + b"\n" + b"z" * 40]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_every_cut(text, chunk):
    want = []
    at = 0
    for line in text.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    if not want[-1][1]:
        want.pop()
    for a in range(len(text) + 2):
        for b in range(a, len(text) + 2):
            got = [x for i, j in ((0, a), (a, b), (b, len(text) + 1)) for x in lines_of(io.BytesIO(text), i, j, chunk=chunk)]
            assert got == want, (a, b)


def test_last_feed(tmp_path):
    for i, text in enumerate(TEXTS):
        (tmp_path / str(i)).write_bytes(text)
        for chunk in (1, 7, 1 << 20):
            assert last_feed(str(tmp_path), str(tmp_path / str(i)), len(text), chunk) == text.rfind(b"\n") + 1


@pytest.mark.parametrize("size", [1, 10, 64 << 20])
def test_batch(spark, tmp_path, size):
    rows = [{"i": i, "t": "é" * (i % 5)} for i in range(40)]
    (tmp_path / "a.jsonl").write_bytes(written(rows[:25]) + b"\n  \n")
    (tmp_path / "b.jsonl").write_bytes(written(rows[25:])[:-1])
    (tmp_path / "_log").write_bytes(b"no json")
    (tmp_path / "c.jsonl").write_bytes(b"")
    found = json_lines(spark, str(tmp_path), "i long, t string", places=True, range_bytes=size).collect()
    assert sorted((r["i"], r["t"]) for r in found) == [(r["i"], r["t"]) for r in rows]
    for r in found:
        line = open(r["path"], "rb").read()[r["place"] :].split(b"\n")[0]
        assert json.loads(line)["i"] == r["i"]
    assert json_lines(spark, str(tmp_path / "c.jsonl"), "i long").collect() == []
    with pytest.raises(Exception, match="MALFORMED"):
        (tmp_path / "d.jsonl").write_bytes(b"{")
        json_lines(spark, str(tmp_path), "i long").collect()


def test_stream_goes_on_at_its_offsets(spark, tmp_path):
    """A file that grows, a line that is half written, a file that comes later."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rows = [{"i": i} for i in range(30)]
    stream = lambda: json_lines(spark, f"file://{folder}", "i long", stream=True, range_bytes=16)
    ids = lambda df: sorted(r["i"] for r in df.collect())
    (folder / "a").write_bytes(written(rows[:10]) + b'{"i": 1')
    assert ids(streams.drain(stream(), out)) == list(range(10))
    with open(folder / "a", "ab") as f:
        f.write(b"0}\n" + written(rows[11:15]))
    (folder / "b").write_bytes(written(rows[15:]))
    assert ids(streams.drain(stream(), out)) == list(range(30))
    assert ids(streams.drain(stream(), out)) == list(range(30))
