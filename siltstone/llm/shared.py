"""What the operators share: tables, the shared folder, and joins whose small side is checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a word of a text is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes that a broadcast may hold, as estimated from the rows: see is_small(). Beyond it the join shuffles.
BROADCAST_BYTES = 12 << 20

#: Bits of the sieve that goes before a large semi or anti join: 16 MB when full, whatever the number of keys.
SIEVE_BITS = 1 << 27

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the setting is absent and the master is local (tests) a temporary folder takes its place; on a
    cluster executors would not see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: The folders of the scratch blocks that are open, the innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """The path of a new folder in the shared one; the scratch block that is open, if any, deletes it: see there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _scratch.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Folders made in this block, mostly tables that stage() writes, are deleted at its end, but for those with
    `keep`, which then belong to the block around it. What leaves the block must read kept tables only. Where a file
    system is unknown to pyarrow the tables stay, for the deployment to delete."""
    outer, own = _scratch.get(), []
    token = _scratch.set((*outer, own))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            try:
                store, folder = fs.FileSystem.from_uri(path)
                store.delete_dir(folder)
            except (pa.ArrowInvalid, OSError):
                continue


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder once and read it back: later steps neither recompute it nor
    depend on an executor that may be lost, and the planner knows its size."""
    path = new_folder(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(staged: DataFrame) -> bool:
    """Whether a staged table may be broadcast: 16 bytes a row and a column, 64 for an element of an array, and
    what its strings hold, make up to BROADCAST_BYTES."""
    n = staged.count()
    if n * (16 + 16 * len(staged.columns)) > BROADCAST_BYTES:
        return False
    long = [F.octet_length(f.name) for f in staged.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    long += [F.size(f.name) * 64 for f in staged.schema if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    more = staged.select(F.sum(sum((F.coalesce(c, F.lit(0)).cast("long") for c in long), F.lit(0)))).first()[0] or 0 if long else 0
    return n * (16 + 16 * len(staged.columns)) + more <= BROADCAST_BYTES


def checked_small(staged: DataFrame) -> DataFrame:
    """staged with a broadcast hint if it is small; else as it is, so that the join shuffles."""
    return F.broadcast(staged) if is_small(staged) else staged


def matching(df: DataFrame, on: dict[str, Column], staged: DataFrame, how: str) -> DataFrame:
    """The rows of df, wide as they are, that have (left_semi) or lack (left_anti) a row in staged. `on` gives the
    value of df for each column of staged that is compared; nulls are equal.

    A small staged side is broadcast. Beyond that its keys are first cast into a bitmap of fixed size, which is
    broadcast: rows of df that miss it have no match and stay where they are, only the others are shuffled and
    joined. So wide rows without a match never move.
    """
    if is_small(staged):
        return df.join(F.broadcast(staged), reduce(and_, (value.eqNullSafe(staged[c]) for c, value in on.items())), how)
    place = lambda values: F.pmod(F.xxhash64(*values), F.lit(SIEVE_BITS)) + 1
    bit = place([staged[c].cast("string") for c in on])
    sieve = stage(staged.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "sieve")
    rows = df.select(F.struct(*df.columns).alias("row"), *(value.alias(f"key_{c}") for c, value in on.items()), place([value.cast("string") for value in on.values()]).alias("bit"))
    rows = rows.join(F.broadcast(sieve), F.bitmap_bucket_number("bit") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.bitmap_bit_position("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("held", F.coalesce(F.floor(byte / F.pow(F.lit(2.0), F.bitmap_bit_position("bit") % 8)) % 2 == 1, F.lit(False)))
    keys = staged.select(*(F.col(c).alias(f"other_{c}") for c in on)).distinct()
    found = rows.where("held").join(keys, reduce(and_, (F.col(f"key_{c}").eqNullSafe(F.col(f"other_{c}")) for c in on)), how).select("row.*")
    return found if how == "left_semi" else rows.where("not held").select("row.*").unionByName(found)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of up to BATCH_BYTES while tables with texts are staged through Python: the default of 10,000
    rows would hold tens of MB of texts several times over in the JVM and in each worker. The session has its own
    setting back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def staged_texts(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """stage() for a table that comes from texts through Python, in small Arrow batches."""
    with small_batches(df.sparkSession):
        return stage(df, name, keep)


def tasks_for(spark: SparkSession, total_bytes: float, task_bytes: int = 256 << 20, most: int = 200_000) -> int:
    """Tasks for a shuffle of wide rows: the session's number of shuffle partitions, or more where these would get
    more than `task_bytes` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, -(-int(total_bytes) // task_bytes)))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one a reused Python worker gives Arrow's free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. An ASCII text takes the quick path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
