"""Ties, nulls, hot keys and empty inputs of the composed operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators.grouping import ranked, running_total, sessions, tile, top_per_key
from siltstone.operators.joins import asof_join, band_join, interval_join, skewed_join

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, t timestamp_ntz, l int", "k string, rt timestamp_ntz, r int"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def test_asof_ties_nulls_and_buckets(spark):
    left = [("a", at(50), 1), ("a", at(0), 2), ("b", at(5), 3), (None, at(5), 4), ("a", None, 5), ("c", at(1), 6)]
    right = [("a", at(1), 10), ("a", at(1), 11), ("a", at(49), None), ("a", at(60), 12), ("b", at(5), 13), (None, at(1), 14), ("b", None, 15)]
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "rt", ["r"]).collect()
    assert {x.l: x.r for x in got} == {1: None, 2: None, 3: 13, 4: None, 5: None, 6: None} and len(got) == 6
    late = asof_join(spark.createDataFrame([("a", at(200), 1)], LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "rt", ["r"]).first()
    assert late.r == 12
    tie = asof_join(spark.createDataFrame([("a", at(1), 1)], LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "rt", ["r"]).first()
    assert tie.r == 11


def test_asof_empty(spark):
    none = spark.createDataFrame([], RIGHT)
    assert asof_join(spark.createDataFrame([("a", at(1), 1)], LEFT), none, "k", "t", "rt", ["r"]).first().r is None


def test_interval_bounds(spark):
    left = spark.createDataFrame([("a", at(0), 1), ("a", at(23), 2), (None, at(0), 3)], LEFT)
    right = spark.createDataFrame([("a", at(h), h) for h in (0, 1, 24, 25, 47, 48)] + [(None, at(0), 9)], RIGHT)
    got = {(x.l, x.r) for x in interval_join(left, right, "k", "t", "rt", 86_400).collect()}
    assert got == {(1, 0), (1, 1), (1, 24), (2, 24), (2, 25), (2, 47)}


def test_skewed_join_keeps_all_rows(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    plain = left.join(right, "k", "left").groupBy("v").count().collect()
    assert sorted(map(str, skewed_join(left, right, "k", how="left").groupBy("v").count().collect())) == sorted(map(str, plain))


def test_top_and_running_and_sessions(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(10)] + [("b", 1, None)], "k string, o int, v int")
    assert top_per_key(df, ["k"], [F.desc("o")], 2).count() == 3
    got = {(x.k, x.o): x.running for x in running_total(df, ["k"], ["o"], "v", F.floor(F.col("o") / 4)).collect()}
    assert got[("a", 9)] == sum(i % 3 for i in range(10)) and got[("a", 3)] == 3
    s = spark.createDataFrame([("a", at(0)), ("a", at(0.4)), ("a", at(2))], "k string, t timestamp_ntz")
    assert sorted(x.n for x in sessions(s, "k", "t").collect()) == [1, 2]


HELPERS = ["_bucket", "_salt", "_slice", "_t", "_w", "bucket", "key", "left", "right", "side", "time", "salt", "slice", "row", "rank", "before", "value", "window", "at", "found"]


def test_helper_columns_do_not_clash(spark):
    """A column of any helper's name comes out as it went in."""
    left = spark.createDataFrame([("a", at(5), 1), ("a", at(30), 2), (None, None, 3)], LEFT).select("*", *(F.lit(i).alias(h) for i, h in enumerate(HELPERS)))
    names = HELPERS
    kept = lambda df: {tuple(r[n] for n in names) for r in df.select(*names).collect()} == {tuple(range(len(names)))}
    right = spark.createDataFrame([("a", at(4), 7)], RIGHT)
    asof = asof_join(left, right, "k", "t", "rt", ["r"])
    assert kept(asof) and {x.l: x.r for x in asof.collect()} == {1: 7, 2: 7, 3: None}
    assert kept(skewed_join(left, spark.createDataFrame([("a", 1)], "k string, v int"), "k", how="left"))
    assert kept(interval_join(left, spark.createDataFrame([("a", at(5), 7)], RIGHT), "k", "t", "rt", 3600))
    assert kept(running_total(left, ["k"], ["l"], "l", F.floor(F.col("l") / 2)))
    assert kept(ranked(left, ["k"], [("l", False)], F.floor(F.col("l") / 2), number="no", rank="rk", of="all"))
    clash = spark.createDataFrame([("a", at(0)), ("a", at(1))], "_t string, at timestamp_ntz")
    assert sessions(clash, "_t", "at").count() == 2


def test_band_join(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, -3.5), (4, None), (5, 99.0)], "l int, v double")
    bands = spark.createDataFrame([("a", 5.0, 10.0), ("b", -10.0, 5.0), ("c", 8.0, 7.0), ("d", None, 100.0), ("e", 10.0, 10.0)], "b string, lo double, hi double")
    got = {(x.l, x.b) for x in band_join(left, "v", bands, "lo", "hi", 3.0).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "a"), (2, "e"), (3, "b")}


def test_ranks_in_two_levels(spark):
    rows = [("a" if i % 3 else None, (i * 7) % 20 if i % 11 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = ranked(df, ["k"], [("v", True), ("i", False)], F.coalesce(F.floor(F.col("v") / -4), F.lit(0)))
    from pyspark.sql import Window as W

    order = W.partitionBy("k").orderBy(F.desc("v"), "i")
    plain = df.select("i", F.row_number().over(order).alias("n"), F.ntile(7).over(order).alias("t"), F.count("*").over(W.partitionBy("k")).alias("c"))
    assert {(x.i, x.number, x.t, x.of) for x in got.withColumn("t", tile(F.col("number"), F.col("of"), 7)).collect()} == {(x.i, x.n, x.t, x.c) for x in plain.collect()}
    ties = ranked(df.where("v is not null"), ["k"], [("v", False)], F.floor(F.col("v") / 4)).collect()
    plain = df.where("v is not null").select("i", F.rank().over(W.partitionBy("k").orderBy("v")).alias("r")).collect()
    assert {(x.i, x["rank"]) for x in ties} == {(x.i, x.r) for x in plain}
