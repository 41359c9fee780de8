"""Selection, closure, hot keys, overlaps, bitmaps: hand-made odd rows against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import skew
from siltstone.operators.closure import ancestors, fixpoint
from siltstone.operators.distinct_counts import bitmaps, counted, merged
from siltstone.operators.joins import band_join, interval_join, overlap_join, skewed_join
from siltstone.operators.quantiles import exact_quantiles

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [1, 40, 4096])
def test_quantiles_of_ties_magnitudes_and_odd_values(spark, few):
    rng = random.Random(1)
    rows = [("ties", rng.choice([1.0, 2.0, 2.0, 2.0])) for _ in range(400)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(400)]
    rows += [(None, rng.gauss(0, 1)) for _ in range(301)] + [("one", 7.5), ("none", None), ("none", float("nan")), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 0.0)]
    shares = [0.0, 0.37, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "of_key string, rank double").repartition(3)
    got = {r.of_key: (r.n, *(r[f"q{i}"] for i in range(5))) for r in exact_quantiles(df, ["of_key"], "rank", shares, few).collect()}
    assert set(got) == {"ties", "wide", None, "one", "none", "ends"}
    for key, (n, *found) in got.items():
        values = sorted(v for k, v in rows if k == key and v is not None and v == v)
        assert n == len(values)
        for share, q in zip(shares, found, strict=True):
            if not values:
                assert q is None
            else:
                low, high = int(np.floor((n - 1) * share)), int(np.ceil((n - 1) * share))
                want = values[low] + (values[high] - values[low]) * ((n - 1) * share - low) if values[low] != values[high] else values[low]
                assert q == want or (key == "ends" and q != q) or abs(q - want) <= 1e-12 * abs(want)


def test_quantiles_without_keys_rows_and_of_whole_numbers(spark):
    df = spark.range(0, 10_001).select((F.col("id") * 7919 % 10_001).alias("v"))
    assert exact_quantiles(df, [], "v", [0.5, 0.25], few=10).first().asDict() == {"n": 10_001, "q0": 5000.0, "q1": 2500.0}
    none = spark.createDataFrame([], "k string, v int")
    assert exact_quantiles(none, ["k"], "v", [0.5]).collect() == []


def test_hot_keys_are_found_and_spread(spark):
    left = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 > 0, 5).when(F.col("id") % 30 == 0, None).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    heavy = {(r.heavy, r.copies) for r in skew.heavy_keys(left.select(F.when(F.col("k").isNotNull(), F.xxhash64("k")).alias("hash")), 4, 100).collect()}
    assert {h for h, _ in heavy} == {spark.range(1).select(F.xxhash64(F.lit(5).cast("long"))).first()[0]} and min(c for _, c in heavy) >= 4
    right = spark.createDataFrame([(5, "a"), (5, "b"), (6, "c"), (None, "d")], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        names = sorted(plain.columns)
        want = Counter(plain.select(*names).groupBy(*names).count().rdd.map(tuple).collect())
        got = skewed_join(left, right, "k", how, least_rows=100)
        assert Counter(got.select(*names).groupBy(*names).count().rdd.map(tuple).collect()) == want


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(0, 8000, 1, 8).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    salted = left.select(F.pmod(F.xxhash64(skew.whole(left)).bitwiseXOR(F.spark_partition_id() * 2654435761), F.lit(4)).alias("s"))
    assert salted.distinct().count() > 1


def chain(parents):
    out = []
    for node in parents:
        at, d = node, 0
        while at in parents:
            at, d = parents[at], d + 1
            out.append((node, at, d))
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 200_000])
def test_ancestors_of_paths_trees_and_odd_edges(spark, monkeypatch, hot):
    from siltstone.operators import closure

    monkeypatch.setattr(closure, "LOOK_FOR_HOT", hot)
    rng = random.Random(2)
    parents = {i: i + 1 for i in range(100, 171)} | {i: rng.randrange(200, i) for i in range(201, 320)} | {i: 7 for i in range(400, 500)}
    edges = [*parents.items(), (100, 101), (None, 3), (7, None), (170, 171)]
    got = ancestors(spark.createDataFrame(edges, "child long, via long").repartition(3), "child", "via").collect()
    assert sorted(tuple(r) for r in got) == chain(parents)
    assert ancestors(spark.createDataFrame([], "c long, p long"), "c", "p").collect() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)], [(1, 2), (1, 3)]])
def test_cycles_and_two_parents_are_refused(spark, edges):
    with pytest.raises(ValueError):
        ancestors(spark.createDataFrame(edges, "c long, p long"), "c", "p")


def test_fixpoint_ends_in_cycles_and_keeps_nulls(spark):
    start = spark.createDataFrame([(1,), (1,), (None,)], "n long")
    got = fixpoint(start, lambda new: new.select((F.col("n") * 3 % 50).alias("n"))).collect()
    want, at = {None}, 1
    while at not in want:
        want.add(at)
        at = at * 3 % 50
    assert sorted(map(str, (r.n for r in got))) == sorted(map(str, want))


def spans(rng, n):
    rows = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randrange(86_400 * 3))
        rows.append((i, rng.choice("abc"), start, start + timedelta(seconds=rng.choice([0, 0, 1, 59, 60, 61, 3600, 40_000]))))
    return [*rows, (n, "a", T0 - timedelta(days=100), T0 + timedelta(days=265)), (n + 1, None, T0, T0 + timedelta(days=1)), (n + 2, "a", T0, T0 - timedelta(1)), (n + 3, "b", None, T0), (n + 4, "b", T0, None)]


@pytest.mark.parametrize("key", [None, "row"])
def test_overlaps_of_short_and_year_long_spans(spark, key):
    rng = random.Random(3)
    a, b = spans(rng, 80), spans(rng, 70)
    schema = "point int, row string, low timestamp_ntz, high timestamp_ntz"
    got = overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "low", "high", key, names=("range", "number")).collect()
    good = lambda s: s[2] is not None and s[3] is not None and s[2] <= s[3]
    want = [(x[0], y[0]) for x in a for y in b if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3] and (key is None or (x[1] is not None and x[1] == y[1]))]
    assert sorted((r.range.point, r.number.point) for r in got) == sorted(want)
    assert overlap_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), "low", "high").count() == 0


def test_bands_without_ends_and_intervals_of_no_width(spark):
    inf = float("inf")
    left = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, -1e300, 5.0, 1e18, inf, float("nan"), None, -3.25])], "l int, v double")
    bands = spark.createDataFrame([("all", -inf, inf), ("up", 1.0, inf), ("down", -inf, -3.25), ("wide", -1e6, 1e6), ("nan", float("nan"), float("nan"))], "b string, lo double, hi double")
    got = {(r.l, r.b) for r in band_join(left, "v", bands, "lo", "hi", 1e-3).collect()}
    want = {(i, "all") for i in (0, 1, 2, 3, 4, 7)} | {(i, "up") for i in (2, 3, 4)} | {(i, "down") for i in (1, 7)} | {(i, "wide") for i in (0, 2, 7)}
    assert {x for x in got if x[1] != "nan"} == want and {x[0] for x in got if x[1] == "nan"} <= {5}
    times = [(1, T0), (1, T0 + timedelta(seconds=1)), (2, None), (None, T0)]
    a, b = spark.createDataFrame(times, "k int, t timestamp_ntz"), spark.createDataFrame(times, "k int, u timestamp_ntz")
    assert sorted((r.t, r.u) for r in interval_join(a, b, "k", "t", "u", 0).collect()) == [(t, t) for _, t in times[:2]]


def test_bitmaps_merge_to_exact_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y"]), rng.choice([0, 1, -1, -40_000, 32_767, 32_768, 10**12, None, rng.randrange(10**6)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "bucket_day int, kind string, v long")
    maps = bitmaps(df, ["bucket_day", "kind"], "v")
    want = {k: len({v for a, b, v in rows if (a, b) == k and v is not None}) for k in {(a, b) for a, b, _ in rows}}
    assert {(r.bucket_day, r.kind): r.n for r in counted(maps, ["bucket_day", "kind"]).collect()} == want
    by_kind = {r.kind: r.n for r in counted(merged(maps, ["kind"]), ["kind"]).collect()}
    assert by_kind == {k: len({v for _, b, v in rows if b == k and v is not None}) for k in "xy"}
    assert counted(bitmaps(df.limit(0), [], "v"), []).first().n is None
