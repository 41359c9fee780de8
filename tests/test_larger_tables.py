"""What queries hold or do must not grow with the table: plans and odd rows."""

from __future__ import annotations

import random

import pytest
from oracle import expected, rows

from siltstone.operators import quantiles
from siltstone.plans.catalog import ORACLES, QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sketch_is_kept_for_each_key(spark, sf_dir):
    lines = plan(QUERIES["distinct_estimate"](spark, sf_dir)).splitlines()
    sketches = [x for x in lines if "approx_count_distinct" in x and "Aggregate(keys=" in x]
    assert sketches and all("Aggregate(keys=[]," in x for x in sketches)


def test_words_of_odd_names(spark, tmp_path):
    names = ["a b", "", None, " two  spaces ", "one"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["table_function"](spark, str(tmp_path))
    assert rows(found) == expected(str(tmp_path), ORACLES["table_function"])
    assert "Python" not in plan(found)


def test_no_group_is_shuffled_to_find_its_quantiles(spark, monkeypatch):
    plans = []
    real = quantiles.staged
    monkeypatch.setattr(quantiles, "staged", lambda df, name: plans.append((name, plan(df))) or real(df, name))
    rng = random.Random(5)
    df = spark.createDataFrame([("ab"[i % 2], rng.random()) for i in range(2000)], "k string, v double").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark thinks the intervals many
    try:
        assert quantiles.exact_quantiles(df, ["k"], "v", [0.5], few=20).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joined = [p for name, p in plans if name in ("quantile-splits", "quantile-found")]
    assert joined and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in joined)
    assert all("BroadcastHashJoin" in p for name, p in plans if name == "quantile-counts")


@pytest.mark.parametrize("few", [1, 20])
def test_quantiles_where_intervals_are_not_sent(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "SENT", 0)
    df = spark.range(1001).selectExpr("id % 2 as k", "id as v")
    assert sorted((r.k, r.q0) for r in quantiles.exact_quantiles(df, ["k"], "v", [0.5], few).collect()) == [(0, 500.0), (1, 500.0)]


def test_latest_orders_where_keys_and_dates_are_missing(spark, tmp_path):
    customers = [(1, 6000.0), (2, 6000.0), (3, 6000.0), (1, 7000.0), (None, 9000.0), (4, 5000.0)]
    orders = [(None, 1, "2024-01-02"), (5, 1, "2024-01-02"), (4, 1, "2024-01-02"), (6, 1, "2024-01-01"), (7, 2, None), (8, 2, "2024-01-01"), (None, 2, None), (9, None, "2024-01-01"), (None, 3, None)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "cast(d as timestamp_ntz) as o_orderdate")
    frame.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = rows(QUERIES["lateral_top"](spark, str(tmp_path)))
    assert found == expected(str(tmp_path), ORACLES["lateral_top"])
    assert found == sorted([("1", "4"), ("1", "5"), ("1", "4"), ("1", "5"), ("2", "8"), ("2", "7"), ("3", "null")])
