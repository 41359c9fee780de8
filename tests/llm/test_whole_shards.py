from __future__ import annotations

from siltstone.llm import queries, sharding


def test_query_shards_all_columns(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "sharded", lambda docs: seen.append(docs.columns) or sharding.sharded(docs))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert queries.op10_shards(spark, sf_dir).count() == documents.count()
    assert seen == [documents.columns]


def test_one_identifier_is_spread_over_buckets(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(200)], "doc_id long, text string")
    path = sharding.new_folder(spark, "test-shards")
    out = sharding.write_shards(docs, path, shards=3, bucket_bytes=200).collect()
    written = spark.read.parquet(path)
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(200))
    assert written.select("_bucket").distinct().count() > 1


def test_equal_rows_are_dealt_to_all_buckets_in_one_shuffle(spark):
    """20,000 equal rows fill several buckets evenly, slots have no gap, reruns agree whatever the partitions, and
    written rows are joined with nothing."""
    from collections import Counter

    rows = [(7, "the same text", "a")] * 20_000 + [(7, "the same text", "b")] * 3 + [(i, f"text {i}", None) for i in range(300)]
    runs = []
    for parts in (3, 5):
        path = sharding.new_folder(spark, "test-shards")
        out = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, _copies string").repartition(parts), path, shards=2, bucket_bytes=2000)
        assert "Join" not in out._jdf.queryExecution().toString()
        runs.append(sorted((r.shard, r.slot, r.row.doc_id, r.row._copies or "") for r in out.collect()))
        sizes = Counter((r._shard, r._bucket) for r in spark.read.parquet(path).where("row._copies = 'a'").select("_shard", "_bucket").collect())
        assert len(sizes) > 20 and max(sizes.values()) - min(sizes.values()) <= 1
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    for shard in (0, 1):
        assert [s for x, s, _, _ in runs[0] if x == shard] == list(range(sum(x == shard for x, *_ in runs[0])))
