"""How many rows overlaps send, and that every pair is met once whatever the spans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import dyadic, joins

T0 = datetime(2024, 1, 1)
SCHEMA = "user long, low timestamp_ntz, high timestamp_ntz"


def spans(n, seed=6):
    rng = random.Random(seed)
    rows = [(rng.randrange(20), T0 + timedelta(minutes=rng.randrange(3000)), rng.choice([0, 0, 0, 1, 15, 40, 200])) for _ in range(n)]
    return [(u, t, t + timedelta(minutes=m)) for u, t, m in rows]


def test_moments_are_no_ranges_and_points_go_to_few_levels(spark, monkeypatch):
    sent = []
    real = dyadic.skewed_join
    monkeypatch.setattr(dyadic, "skewed_join", lambda left, right, key: sent.append((left.count(), right.count())) or real(left, right, key))
    rows = [*((i, T0 + timedelta(minutes=i), T0 + timedelta(minutes=i)) for i in range(200)), (999, T0, T0 + timedelta(minutes=180))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert joins.overlap_join(df, df, "low", "high").count() == 201 + 2 * 181
    assert sum(points for points, _ in sent) <= 2 * 2 * 201 and sum(blocks for _, blocks in sent) <= 2 * 31


@pytest.mark.parametrize("grain", [0.5, 60.0, 1e6])
def test_pairs_among_one_table_are_those_of_the_join(spark, grain):
    rows = [*spans(120), (3, T0 - timedelta(days=4000), T0 + timedelta(days=9000)), (4, T0 - timedelta(days=4000), T0), (None, T0, T0 + timedelta(days=1)), (5, None, T0), (5, T0, None), (6, T0, T0 - timedelta(1))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = joins.overlaps_among(df, "low", "high", "user", grain).selectExpr("left.*", "right.user as u", "right.low as l", "right.high as h").collect()
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    want = [(*a, *b) for a in good for b in good if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, T0, T0, "x"), (2, T0, T0 + timedelta(1), "y"), (3, T0 + timedelta(hours=1), T0 + timedelta(1), "z")], "`key` long, `from` timestamp_ntz, `to` timestamp_ntz, c0 string")
    got = joins.overlaps_among(df, "from", "to", "key", names=("a", "b")).select("a.c0", "b.c0").collect()
    assert sorted(map(tuple, got)) == [("x", "y"), ("y", "z")]


def test_blocks_of_a_range_hold_each_of_its_numbers_once(spark):
    rng = random.Random(7)
    pairs = [(low, low + rng.choice([0, 1, 14, 15, 16, 17, 255, 256, 300, 5000])) for low in (rng.randrange(10_000) for _ in range(60))] + [(5, 4), (0, 4095), (0, (1 << dyadic.BITS) - 1)]
    levels = dyadic.LEVELS
    df = spark.createDataFrame(pairs, "low long, high long").withColumn("cover", dyadic.cover(F.col("low"), F.col("high")))
    for low, high, cover in df.collect():
        runs = sorted(((b & ((1 << dyadic.BITS) - 1)) << (b >> dyadic.BITS), 1 << (b >> dyadic.BITS)) for b in cover)
        assert all(b >> dyadic.BITS in levels for b in cover) and len(runs) <= 30 * len(levels)
        at = low
        for first, size in runs:
            assert first == at
            at += size
        assert at == high + 1 or (high < low and not runs)
