"""Layouts, broken lines, versions and exports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.columns import variant_leaves
from siltstone.sources import export as ex
from siltstone.sources.checked import read_lines, read_versions
from siltstone.sources.layout import by_bucket, laid_out
from siltstone.sources.tables import shared_folder
from siltstone.streaming import events as streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_joined_without_exchange(spark):
    a = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    b = spark.range(300).select(F.when(F.col("id") != 7, F.col("id")).alias("j"), F.col("id").alias("w"))
    with by_bucket(a, "left_side", 8, "k") as x, by_bucket(b, "right_side", 8, "j") as y:
        joined = x.hint("merge").join(y, x["k"] == y["j"])
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and len(x.inputFiles()) <= 8
        assert joined.count() == sum(i % 300 != 7 for i in range(2000))
        names = [r.tableName for r in spark.sql("show tables").collect()]
        assert any(n.startswith("left_side") for n in names)
    assert not any(n.startswith("left_side") for n in (r.tableName for r in spark.sql("show tables").collect()))


def test_partitions_are_pruned_by_the_other_side(spark):
    facts = spark.range(1000).select((F.col("id") % 50).cast("int").alias("day"), "id")
    days = spark.createDataFrame([(d, f"w{d % 10}") for d in range(50)], "day int, week string")
    with laid_out(facts.repartition("day"), "facts", partition_by=["day"]) as table:
        joined = table.join(F.broadcast(days.where("week = 'w3'")), "day")
        assert "dynamicpruning" in plan(joined)
        assert joined.count() == 100


def test_broken_lines_are_counted_and_none_is_lost(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": 2}', '{"b": null, "c": 9}', '{"a": 1, "b"', "not json", '{"a": "text", "b": "y"}', "", '{"a": null, "b": ""}', "[1, 2]"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    schema = spark.createDataFrame([], "a int, b string").schema
    good, bad = read_lines(spark, str(tmp_path), schema)
    assert sorted((tuple(r) for r in good.collect()), key=str) == sorted([(1, "x"), (2, None), (None, None), (None, "")], key=str)
    assert sorted(r.line for r in bad.collect()) == sorted(['{"a": 1, "b"', "not json", '{"a": "text", "b": "y"}', "[1, 2]"])


def test_versions_have_all_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "v1"))
    spark.createDataFrame([(2, 5.0)], "a int, c double").write.parquet(str(tmp_path / "v2"))
    spark.createDataFrame([("t",)], "a string").write.parquet(str(tmp_path / "v3"))
    both = read_versions(spark, [str(tmp_path / "v1"), str(tmp_path / "v2")])
    assert {(r.a, r.b, r.c) for r in both.collect()} == {(1, "x", None), (2, None, 5.0)}
    with pytest.raises(Exception):
        read_versions(spark, [str(tmp_path / "v1"), str(tmp_path / "v3")]).collect()


TEXTS = ["", None, "tab\there", "line\nend\r", "back\\slash \\n \\0", "# not a head", "ü" * 40, "-"]


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_exports_come_back_in_pieces_as_they_were(spark, monkeypatch, piece):
    rng = random.Random(piece)
    rows = [(c if c != 5 else None, t, rng.choice(["user", "a\tb", None, ""]), rng.choice(TEXTS)) for c in range(-3, 30) for t in [*range(rng.randrange(5)), *([None] if c == 4 else [])]]
    path = shared_folder(spark, "export-test")
    ex.export(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("more", F.lit(1)).repartition(3), path)
    files = ex._files(path)
    monkeypatch.setattr(ex, "PIECE", piece)
    pieces = ex._pieces(files)
    key = lambda r: tuple(map(str, r))
    assert sorted((r for p in pieces for r in ex._turns(path, p)), key=key) == sorted(rows, key=key)
    assert sorted((tuple(r) for r in ex.read_export(spark, path).collect()), key=key) == sorted(rows, key=key)


def test_exports_skip_files_and_grow_as_streams(spark):
    path = shared_folder(spark, "export-test")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    ex.export(rows(0, 400), path)
    reader = ex.PushedReader(path)
    list(reader.pushFilters([ex.EqualTo(("conv_id",), 3), ex.GreaterThan(("text",), "a")]))
    assert len(reader.partitions()) < len(ex._files(path)) and reader.low == reader.high == 3
    assert ex.read_export(spark, path).where("conv_id = 3").count() == 1 and ex.read_export(spark, path).where("conv_id > 397").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = ex.read_export(spark, path).where("conv_id = 3")
        assert pushed.count() == 1 and pushed.rdd.getNumPartitions() < ex.read_export(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    first = streams.finished(ex.stream_export(spark, path))
    assert first.count() == 400
    ex.export(rows(400, 500), path)
    assert ex.read_export(spark, path).count() == 500 and streams.finished(ex.stream_export(spark, path)).count() == 500
    source = ex.StreamReader(path)
    assert source.partitions(source.latestOffset(), source.latestOffset()) == []


def test_variants_are_taken_apart_to_a_depth(spark):
    texts = ['{"a": 1, "b": {"c": [1, {"d": "x"}, null], "e": {}}, "f": null}', "[true, 2.5]", "7", "null", "broken {", None]
    rows = spark.createDataFrame([(t,) for t in texts], "path string").select(F.try_parse_json("path").alias("value"))
    got = sorted((r.path, r.text) for r in variant_leaves(rows, "value").select("path", F.to_json("value").alias("text")).collect())
    assert got == sorted([("$.a", "1"), ("$.b.c[]", "1"), ("$.b.c[].d", '"x"'), ("$[]", "true"), ("$[]", "2.5")])
    shallow = {r.path for r in variant_leaves(rows, "value", depth=1).collect()}
    assert shallow == {"$.a", "$.b", "$[]"}
