from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

from siltstone.llm.queries import ORACLES, QUERIES
from siltstone.llm.shared import new_folder
from siltstone.llm.warc import coalesced, read_warc, write_warc


def test_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op3_warc"](spark, sf_dir)) == expected(sf_dir, ORACLES["op3_warc"])


def test_round_trip_of_copies_nulls_and_repeats(spark):
    pages = [(i, f"http://h/{i}", "same <b>é</b>\r\n\r\nbody", i) for i in range(30)] + [(100, None, None, 0), (101, "u\nv", "", 0), (102, "x", "y" * 400_000, 0), (102, "x", "y" * 400_000, 0), (None, "n", "alone", 0), (None, "m", "y" * 400_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    path = new_folder(spark, "warc")
    index = write_warc(df, path)
    got = read_warc(index, path).collect()
    assert len(got) == len(pages)
    top: dict = defaultdict(lambda: None)
    for i, _, h, _ in pages:
        if i is not None and (top[h or ""] is None or i > top[h or ""]):
            top[h or ""] = i
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r)
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode().rstrip("=")
        r = next(r for r in by_id[i] if r.payload_digest == sha)
        first = top[h or ""] in (None, i)
        assert r.payload_bytes == len(raw) and r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else top[h or ""])
        assert r.payload == (raw if first else None)


def test_some_records_by_index(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"body {i}") for i in range(50)], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    index = write_warc(df, path)
    some = read_warc(index.where("page_id % 10 = 3"), path).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in some) == [(i, f"body {i}".encode()) for i in range(3, 50, 10)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    assert read_warc(write_warc(df, path), path).count() == 0


def test_minimum_bytes(spark):
    df = spark.createDataFrame([(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "large " * 9), (4, "d", "large " * 9)], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    assert {r.page_id: r.refers_to for r in read_warc(write_warc(df, path, least_bytes=10), path).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_coalescing():
    assert coalesced([(0, 10), (12, 5), (100, 5), (500, 1)], gap=5, most=50) == [(0, 17, 0, 1), (100, 105, 2, 2), (500, 501, 3, 3)]
    assert coalesced([(0, 30), (30, 30)], gap=5, most=50) == [(0, 30, 0, 0), (30, 60, 1, 1)]


def test_revisits_beyond_broadcasts(spark, monkeypatch):
    from siltstone.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(i, f"u{i}", f"body {i % 7}") for i in range(40)] + [(None, "n", "body 3"), (50, "x", "alone")], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    got = {r.page_id: r.refers_to for r in read_warc(write_warc(df, path), path).collect()}
    top = {i % 7: i for i in range(40)}
    assert got == {i: None if i == top[i % 7] else top[i % 7] for i in range(40)} | {None: top[3], 50: None}
