"""Texts beyond the sizes at which operators begin to work in parts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from ragmill.llm import near_copies, packing, simhash, warc
from ragmill.llm.common import new_path

from .test_brute_force import tokens


def words(n, seed=1):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(50_000)}" for _ in range(n))


def test_fingerprint_beyond_a_part():
    text = words(150_000).encode()
    ws = text.split()
    hs = np.array([xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(len(ws) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))
    assert simhash.fingerprint(text) == want
    sets = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(ws[i : i + 5]), 42) for i in range(len(ws) - 4)], np.uint64))
    assert (near_copies.shingle_set(text) == sets).all()


def test_long_payload(spark):
    """A member beyond 16 MiB does not end in a zero byte by itself."""
    rnd = np.random.default_rng(1)
    text = "".join(map(chr, rnd.integers(32, 0x2FFF, 9_000_000).tolist()))
    pages = [(1, "u", "small"), (2, "u", text), (3, "u", text)]
    path = new_path(spark, "test-long")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    rows = {r["page_id"]: r for r in warc.read_warc(spark, path).select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to").collect()}
    data = text.encode()
    assert rows[2]["payload_digest"] == hashlib.sha256(data).hexdigest() and rows[2]["payload_bytes"] == len(data) > 16 << 20
    assert (rows[3]["record_type"], rows[3]["refers_to"], rows[1]["record_type"]) == ("revisit", 2, "response")


def test_long_text_in_pieces(spark):
    text = words(30_000, 2)
    rows = sorted(packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r["piece"])
    n = len(tokens(text))
    assert [r["length"] for r in rows] == [n % 2048 or 2048] + [2048] * (len(rows) - 1) and sum(r["length"] for r in rows) == n
