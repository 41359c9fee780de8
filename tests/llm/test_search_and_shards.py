from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siltstone.llm import topk_search
from siltstone.llm.queries import ORACLES, QUERIES
from siltstone.llm.sharding import sharded
from siltstone.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def test_topk_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op8_topk"](spark, sf_dir)) == expected(sf_dir, ORACLES["op8_topk"])


def test_topk_odd_rows_and_pruned_blocks(spark, monkeypatch):
    """Clustered vectors, many copies of one, ties, nulls; small blocks so that several pivots take part."""
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 64)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(1500)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]
    odd = [(2000, None), (2001, [1.0, None]), (2100, [math.inf] * 6), (2200, [math.nan] * 6), (None, [9.0] * 6), (2300, [0.5, 0.5]), (100, rows[100][1]), (2400, [])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows + odd], SCHEMA)
    held = {r.vec_id: r.embedding for r in df.where("embedding is not null").collect() if r.vec_id is not None}
    held = {i: [math.floor(1024 * x) for x in v] for i, v in held.items() if all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in held if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(held[q], v, strict=False)), i) for i, v in held.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:10], 1)}
    got = top_k(df, F.col("id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, "")], SCHEMA)
    assert [tuple(r) for r in top_k(df, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert top_k(df.where("vec_id = 1"), F.col("id") % 100 == 0).count() == 0 and top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def check_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert len(rows) == len(texts)


def test_shards_of_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_shards"](spark, sf_dir).collect()
    check_shards(got, docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
    again = QUERIES["op10_shards"](spark, sf_dir).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_odd_rows_in_small_buckets(spark):
    rows = [(i, "t" * (i % 50), i) for i in range(2000)] + [(None, f"n{i}", 0) for i in range(300)] + [(5, None, 1), (6, "", 2)] + [(7, "same", 3)] * 40
    out = sharded(spark.createDataFrame(rows, "doc_id long, text string, slot int"), bucket_bytes=500).collect()
    check_shards(out, rows)
    assert Counter((r.row.doc_id, r.row.text, r.row.slot) for r in out) == Counter(rows)
    assert len({r.shard for r in out if r.row.doc_id == 7}) == 1
    order = [r.row.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.row.doc_id is not None]
    assert order != sorted(order) and max(Counter(r.shard for r in out if r.row.doc_id is not None and r.row.doc_id < 2000).values()) < 400
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_hits(rows, k=10):
    """Pairs of a query row (id divisible by 100) and a row of another id, the k best of each query id."""
    rows = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows}
    out = set()
    for q in {i for i, _ in rows if i % 100 == 0}:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for j, v in rows if j == q for i, w in rows if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], 0, "") for i, v in rows], SCHEMA.replace("float", "double"))


def test_topk_repeated_query_ids(spark):
    """Twelve near vectors of one query id don't stand in for the hits of other ids."""
    rng = random.Random(8)
    rows = [(100, [1 + rng.gauss(0, 0.01), 0, 0]) for _ in range(12)] + [(i, [rng.gauss(0, 0.3) for _ in range(3)]) for i in range(1, 6)]
    got = top_k(frame(spark, rows), F.col("id") % 100 == 0).collect()
    assert len(got) == 10 and {tuple(r) for r in got} == brute_hits(rows)


def test_topk_large_scores_are_exact(spark):
    rows = [(0, [100_000.0009765625, 3.0]), (1, [100_000.0029296875, 1.0]), (2, [100_000.001953125, 2.0]), (100, [4e9, -4e9]), (3, [5e9, 1.0]), (4, [6e9, 1.0]), (5, [-6e9, 1.0])]
    got = top_k(frame(spark, rows), F.col("id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == brute_hits(rows)
    assert {r.score for r in got} >= {2**63 - 1, -(2**63)}


def clustered(n, clusters, width, spread, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[rng.randrange(clusters)]]) for i in range(n)]


def test_topk_ships_what_bounds_leave(spark, monkeypatch):
    """Of all pairs of a vector and a block of queries few are sent if the vectors are clustered; without clusters a
    vector is sent once for each block."""
    monkeypatch.setattr(topk_search, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    shares = {}
    for name, rows in (("clustered", clustered(3000, 30, 8, 0.02)), ("spread", clustered(3000, 3000, 16, 0.0))):
        df = frame(spark, rows)
        data, queries, pivots = topk_search.prepared(df, F.col("id") % 100 == 0, 10, 1024, "vec_id", "embedding")
        plan = topk_search.planned(data, queries, pivots, 10)
        shares[name] = plan.sent(data).count() / (len(rows) * 15)  # 30 queries
        assert {tuple(r) for r in top_k(df, F.col("id") % 100 == 0).collect()} == brute_hits(rows)
    assert shares["clustered"] < 0.3 and shares["spread"] <= 1


def rendezvous(doc_id, shards, seed=29):
    """The shard by hand: Spark chains the hash of each value as the seed of the next, from 42."""
    import struct

    import xxhash

    def weight(s):
        h = 42
        for kind, value in (("<q", doc_id), ("<i", s), ("<i", seed)):
            h = h if value is None else xxhash.xxh64_intdigest(struct.pack(kind, value), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    return max(range(shards), key=lambda s: (weight(s), s))


def test_shards_equal_brute_force_and_nine_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    eight = {r.doc_id: (r.shard, r.grown_shard) for r in sharded(docs, shards=8).select("row.doc_id", "shard", "grown_shard").collect()}
    nine = {r.doc_id: r.shard for r in sharded(docs, shards=9).select("row.doc_id", "shard").collect()}
    assert eight == {d: (rendezvous(d, 8), rendezvous(d, 9)) for d in eight} and nine == {d: g for d, (_, g) in eight.items()}


def test_shards_are_a_fisher_yates_order_of_each_bucket(spark):
    """The order within a bucket is a shuffle of the rows in the order of their tie hashes."""
    import numpy as np

    from siltstone.llm.sharding import new_folder, write_shards

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    path = new_folder(spark, "test-shards")
    write_shards(docs, path, shards=2, bucket_bytes=1000)
    written = spark.read.parquet(path).withColumn("tie", F.xxhash64("row.doc_id", F.xxhash64("row.text"), F.lit(31))).collect()
    buckets = defaultdict(list)
    for r in written:
        buckets[r._shard, r._bucket].append(r)
    assert len(buckets) > 4
    for (shard, number), rows in buckets.items():
        order = np.arange(len(rows))
        np.random.default_rng([29, shard, number]).shuffle(order)
        ties = sorted(r.tie for r in rows)
        assert [r.tie for r in sorted(rows, key=lambda r: r._place)] == [ties[i] for i in order]
