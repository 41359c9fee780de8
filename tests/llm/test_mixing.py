from __future__ import annotations

import re
from collections import defaultdict

import pytest

from siltstone.llm.mixing import integral, mix, mixed_documents
from siltstone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, size string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op1_mix_sources"](spark, sf_dir)) == expected(sf_dir, ORACLES["op1_mix_sources"])


def brute_targets(sizes: dict, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return target | got
        target |= {s: most * sizes[s] for s in over}
        free -= over


def test_targets_nulls_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "abc"[i % 3], "clash") for i in range(60)] + [(60, None, "a", None), (61, "x y", None, None), (None, "q", "b", None), (3, " \t\n", "b", None), (5, "w w w w w w", "c", "clash"), (5, "w w w w w w", "c", "clash")]
    got = mix(docs(spark, rows), keep=["doc_id", "text", "source", "size"]).select("row.*", "taken", "target", "source_size", "positions").collect()
    sizes: dict = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    taken: dict = defaultdict(int)
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * n
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_positions_follow_the_schedule(spark):
    """A source whose weight falls to zero is due in the first half more often than in the second."""
    rows = [(i, "w " * 10, "a", None) for i in range(400)] + [(i, "w " * 10, "b", None) for i in range(400, 800)]
    curriculum = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0)))
    assert [integral(s) for s in curriculum] == [1.0, 1.0]
    got = mix(docs(spark, rows), curriculum, share=1.0, max_repeat=1, keep=["source"]).select("row.source", "positions").collect()
    early = [p for r in got if r.source == "a" for p in r.positions if p < 0.5]
    late = [p for r in got if r.source == "b" for p in r.positions if p < 0.5]
    assert len(early) == pytest.approx(300, abs=3) and len(late) == pytest.approx(100, abs=3)


def test_documents_repeat_whole_and_empty_table(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], str(i)) for i in range(40)]
    out = mixed_documents(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size"]
    counts: dict = defaultdict(int)
    for r in out.collect():
        assert (r.doc_id, r.text, r.source, r.size) in rows
        counts[r.doc_id] += 1
    assert set(counts.values()) <= {1, 2}
    assert mixed_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_documents_come_at_their_positions(spark, parts):
    """Whole documents in training order, over partitions too, are the copies that mix() places, sorted."""
    rows = [(i, "w " * (i * 7 % 40 + 1), "abcd"[min(3, i * i % 7)], f"k{i}") for i in range(700)] + [(None, f"n {i}", "a", "null id") for i in range(50)] + [(8, f"again {i}", "b", "id 8") for i in range(50)] + [(900, None, "a", None)]
    df = docs(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [(r.doc_id, r.text, r.source, r.size) for r in mixed_documents(df.repartition(3)).collect()]
        placed = mix(df, keep=["doc_id", "text", "source", "size"]).selectExpr("row.*", "size as words", "copies", "positions", "ticket").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for r in placed:
        taken = [c for c in r.copies if c > 0]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want += [((p, r.ticket), (r.doc_id, r.text, r.source, r["size"])) for c, p in zip(taken, r.positions, strict=True) if 2 * c >= words]
    assert got == [w for _, w in sorted(want, key=lambda w: w[0])]


def test_reruns_agree_without_identifiers(spark):
    """Rows that share an identifier or have none are taken alike however the table is partitioned, and spread."""
    rows = [(None, t, "s", None) for t in ("a b c", "d e f", "g h i")] + [(7, t, "s", None) for t in ("j k l", "m n o")] + [(1, "x " * 5, "t", None)]
    runs = []
    for n in (1, 2, 3):
        got = mix(docs(spark, rows).repartition(n), keep=["doc_id", "text"]).select("row.*", "taken", "positions", "ticket").collect()
        runs.append(sorted(map(str, got)))
    assert runs[0] == runs[1] == runs[2] and len({r.ticket[:2] for r in got}) > 1


STEEP = [
    (((0.0, 0.0), (0.9, 0.01), (1.0, 20.0)), ((0.0, 0.0), (0.8, 0.02), (1.0, 9.0))),
    (((0.0, 0.0), (0.94, 0.0), (0.95, 50.0), (1.0, 50.0)),),
    (((0.0, 30.0), (0.02, 0.0), (1.0, 0.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 0.0))),
]


@pytest.mark.parametrize("curriculum", STEEP)
def test_steep_schedules_fill_parts_alike(spark, curriculum):
    """No part holds more than twice the mean of words, and the order is still that of the positions."""
    from pyspark.sql import functions as F

    rows = [(i, "w " * (i * 7 % 40 + 1), "aab"[i % 3], f"k{i}") for i in range(1600)]
    df = docs(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = mixed_documents(df, curriculum)
        got = [(r.doc_id, r.size) for r in out.collect()]
        words = [r.words for r in out.groupBy(F.spark_partition_id()).agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("words")).collect()]
        placed = mix(df, curriculum, keep=["doc_id", "size"]).selectExpr("row.*", "size as words", "copies", "positions", "ticket").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for r in placed:
        taken = [c for c in r.copies if c > 0]
        want += [((p, r.ticket), (r.doc_id, r["size"])) for c, p in zip(taken, r.positions, strict=True) if 2 * c >= r.doc_id * 7 % 40 + 1]
    assert got == [w for _, w in sorted(want, key=lambda w: w[0])]
    assert max(words) <= 2 * sum(words) / 16


@pytest.mark.parametrize("curriculum", [(((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))), (((0.0, 0.0), (1.0, 0.0)),)])
def test_a_source_of_no_weight_is_left_out(spark, curriculum):
    rows = [(i, "w " * 10, "ab"[i % 2], None) for i in range(100)]
    got = mix(docs(spark, rows), curriculum, keep=["source"]).collect()
    assert {(r.row.source, r.target) for r in got} == {("a", 0.0), ("b", 1000.0 if len(curriculum) > 1 else 0.0)}
    assert all(r.taken == 0 for r in got if r.row.source == "a") and len(got) == 100
    assert {r.source for r in mixed_documents(docs(spark, rows), curriculum).collect()} <= {"b"}
