"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes into buckets of a size that fits a task's memory, each
within one shard. Pass two shuffles each bucket by Fisher-Yates under a seed of its own and writes it;
the buckets of a shard, one after another, are the shard. The shard itself is chosen by rendezvous
hashing: of all shards the one with the largest hash of (identifier, shard), so that one shard more
takes records only into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_folder, stage

#: Bytes of text that one bucket should hold; tasks of the second pass at most.
BUCKET_BYTES, TASKS = 24 << 20, 50_000

#: Rows alike in identifier and text that are dealt out if they are equal; how many such groups at most.
OFTEN, MOST = 1_000, 1_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    best = F.greatest(*(F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards))) if shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"].cast("int")


def _fisher_yates(seed: int):
    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        """One bucket, in Fisher-Yates order, with the place of each record and its slot. Records come in any order
        from the exchange, so they are first put in one of their own. One row holds the slot of the bucket's first
        record, and no record."""
        _, shard, number = (k.as_py() for k in key)
        first = pa.compute.max(bucket["_first"]).as_py()
        bucket = bucket.filter(pa.compute.is_null(bucket["_first"])).drop_columns(["_task", "_first"])
        bucket = bucket.take(pa.compute.sort_indices(bucket, sort_keys=[("_tie", "ascending"), ("_row", "ascending")]))
        record = np.repeat(np.arange(bucket.num_rows), bucket["_copies"].to_numpy())
        order = np.arange(len(record))
        np.random.default_rng([seed, shard, number]).shuffle(order)
        place = np.arange(len(order))
        return bucket.drop_columns(["_copies", "_row"]).take(pa.array(record[order])).append_column("_place", pa.array(place)).append_column("_slot", pa.array(place + first))

    return shuffle


def _often(docs: DataFrame, same: Column, size: Column) -> tuple[int, list[int]]:
    """The bytes of docs, and the hashes of identifier and text that at least OFTEN rows share, found by a sketch of
    bounded size; a share of 1 in 4,000 rows is always seen, and at most MOST are looked at."""
    found = docs.agg(F.sum(size).alias("bytes"), F.call_function("approx_top_k", same, F.lit(MOST), F.lit(16 * MOST)).alias("top")).first()
    return found.bytes or 0, [x["item"] for x in found.top or [] if x["count"] >= OFTEN]


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Equal rows as one with their number, once for each bucket that gets some of them."""
    one = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    share = F.floor(F.col("_n") / buckets) + (F.col("_k") < F.col("_n") % buckets).cast("long")
    each = one.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(buckets), F.col("_n").cast("int")) - 1)))
    return each.withColumn("_bucket", F.pmod(F.col("_bucket") + F.col("_k"), F.lit(buckets)).cast("int")).withColumn("_copies", share).drop("_n", "_k")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 29, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to path as shuffled shards; return the table: `row` (struct of the columns of docs),
    shard, grown_shard, slot.

    Whole rows are shuffled once, and written with their slots: the rows of each bucket are counted before, and its
    first slot travels with them. A null identifier is hashed as such. Rows of one identifier go to one shard and are
    spread over its buckets by their text. Rows alike in every column, if there are many, are dealt to all buckets
    of their shard, unless a column is a map; rows alike in identifier and text alone share a bucket, as do all
    bytes of one text, however long. A null text has no bytes. Columns of docs may have any name. An empty table
    gives empty shards.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1
    text_hash = F.xxhash64(docs[text_col])
    same = F.xxhash64(docs[id_col], text_hash)
    total, often = _often(docs, same, size)
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    spread = F.xxhash64(docs[id_col], text_hash, F.lit(seed + 1))

    no_maps = "map<" not in docs.schema.simpleString()  # maps have no hash
    whole_row = F.xxhash64(F.struct(*docs.columns)) if no_maps else F.lit(0).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.struct(*docs.columns).alias("row"), rendezvous(docs[id_col], shards, seed).alias("_shard"), rendezvous(docs[id_col], shards + 1, seed).alias("_grown"),
            F.pmod(spread, F.lit(buckets)).cast("int").alias("_bucket"), F.xxhash64(docs[id_col], text_hash, F.lit(seed + 2)).alias("_tie"), whole_row.alias("_row"),
        )

    one = F.lit(1).cast("long").alias("_copies")
    if often and buckets > 1 and no_maps:
        scattered = placed(docs.where(~same.isin(often))).select("*", one).unionByName(_dealt(placed(docs.where(same.isin(often))), buckets))
    else:
        scattered = placed(docs).select("*", one)
    counts = scattered.groupBy("_shard", "_bucket").agg(F.sum("_copies").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = stage(counts.select("_shard", "_bucket", first.alias("_first")), "shard-firsts")
    none = [F.lit(None).cast(scattered.schema["row"].dataType).alias("row"), "_shard", F.lit(0).alias("_grown"), "_bucket", *(F.lit(0).cast("long").alias(c) for c in ("_tie", "_row", "_copies"))]
    scattered = scattered.withColumn("_first", F.lit(None).cast("long")).unionByName(firsts.select(*none, "_first"))
    tasks = min(TASKS, buckets * shards)  # a bucket each; beyond TASKS several, one after another
    task = F.pmod(F.col("_shard") * F.lit(buckets) + F.col("_bucket"), F.lit(tasks)).cast("int")
    fields = [f for f in scattered.schema.fields if f.name in ("row", "_shard", "_grown", "_bucket", "_tie")]
    schema = T.StructType([*fields, T.StructField("_place", T.LongType()), T.StructField("_slot", T.LongType())])
    shuffled = scattered.withColumn("_task", task).repartitionById(tasks, "_task").groupBy("_task", "_shard", "_bucket").applyInArrow(_fisher_yates(seed), schema)
    shuffled.drop("_tie").write.parquet(path)
    written = docs.sparkSession.read.schema(shuffled.drop("_tie").schema).parquet(path)
    return written.select("row", F.col("_shard").alias("shard"), F.col("_grown").alias("grown_shard"), F.col("_slot").alias("slot"))


def sharded(docs: DataFrame, **how) -> DataFrame:
    """write_shards() into a new folder of the shared ones; nulls, repeated rows and empty tables as there."""
    return write_shards(docs, new_folder(docs.sparkSession, "shards"), **how)
