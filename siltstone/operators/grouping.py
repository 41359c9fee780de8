"""Grouped operators: top rows of a key, sessions, and running totals and ranks in two levels. Rows travel as one
struct beside the helper columns, so columns of any name are safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged
from .joins import whole

#: Ranges that ranks and running sums are cut into for each shuffle partition.
SLICES_PER_TASK = 2


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their number in the column `rank`, which df must not have. Spark limits the
    rows of a key in each task before the exchange. Null keys are a key; nulls in the order stand where it puts them;
    no rows give none."""
    if rank in df.columns:
        raise ValueError(f"there is a column {rank} already")
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def sessions(df: DataFrame, key: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows of a key with their first_at, last_at and number of rows, n; merging is partial in
    each task. Null keys are a key, rows without a time are in no session. The key has another name than these."""
    if key in ("first_at", "last_at", "n"):
        raise ValueError(f"{key} is the name of a result")
    rows = df.select(df[key].alias("key"), df[time].alias("time"), df[time].cast("timestamp").alias("at"))
    out = rows.groupBy("key", F.session_window("at", gap).alias("window")).agg(F.min("time").alias("first_at"), F.max("time").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("key").alias(key), "first_at", "last_at", "n")


def _sliced(df: DataFrame, keys: Sequence[str], slices: Column | None, order: Sequence[Column], **more: str) -> tuple[DataFrame, list[str], Column]:
    """df as key0, key1, ..., slice, row and more; the names of the keys; whether two rows have one key and slice.

    Without slices the rows are dealt out by ranges of keys and order, whose bounds Spark samples so that they hold
    about as many rows, and written: a slice is one range, a fixed number of rows however the data grow or lean.
    """
    names = [f"key{i}" for i in range(len(keys))]
    kept = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    if slices is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SLICES_PER_TASK
        ranges = df.repartitionByRange(parts, *(F.col(k) for k in keys), *order)
        rows = staged(ranges.select(*kept, F.spark_partition_id().alias("slice"), whole(df).alias("row"), *(F.col(c).alias(n) for n, c in more.items())), "slices")
    else:
        rows = df.select(*kept, slices.alias("slice"), whole(df).alias("row"), *(F.col(c).alias(n) for n, c in more.items()))
    same = F.col("slice").eqNullSafe(F.col("other_slice"))
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"other_{n}"))
    return rows, names, same


def _before(rows: DataFrame, names: list[str], value: Column, total: bool = False) -> DataFrame:
    """For each key and slice (other_...) the sum of value over earlier slices, and over all of them."""
    sums = rows.groupBy(*names, "slice").agg(value.alias("sum"))
    earlier = W.partitionBy(*names).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    out = [F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before")] + ([F.sum("sum").over(W.partitionBy(*names)).alias("total")] if total else [])
    return sums.select(*(F.col(n).alias(f"other_{n}") for n in [*names, "slice"]), *out)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slices: Column | None = None, total: str = "running") -> DataFrame:
    """The running sum of a key in `order`, in two levels. Rows of a slice are summed in one task, slices by their
    sums. `slices`, if given, must not decrease along the order; else see _sliced()."""
    rows, names, same = _sliced(df, keys, slices, [F.col(c) for c in order], value=value)
    inside = W.partitionBy(*names, "slice").orderBy(*(F.col("row")[c] for c in order)).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("value").over(inside))
    return rows.join(_before(rows, names, F.sum("value")), same).select("row.*", (F.col("before") + F.col("inside")).alias(total))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], slices: Column | None = None, number: str = "number", rank: str = "rank", of: str = "of") -> DataFrame:
    """df with row_number, rank and number of rows of a key, in two levels: within a slice of the order, and by the
    counts of slices. `order` is columns and whether they descend, nulls first and last as Spark has them. `slices`,
    if given, must not decrease along it, and rows that tie must share a slice; else see _sliced(): rows that tie in
    keys and order share a range."""
    rows, names, same = _sliced(df, keys, slices, [F.col(c).desc() if down else F.col(c).asc() for c, down in order])
    inside = W.partitionBy(*names, "slice").orderBy(*(F.col("row")[c].desc() if down else F.col("row")[c].asc() for c, down in order))
    rows = rows.withColumn("number", F.row_number().over(inside)).withColumn("rank", F.rank().over(inside))
    place = lambda c: (F.col("before") + F.col(c)).cast("long")
    return rows.join(_before(rows, names, F.count(F.lit(1)), total=True), same).select("row.*", place("number").alias(number), place("rank").alias(rank), F.col("total").alias(of))


def tile(number: Column, of: Column, n: int) -> Column:
    """ntile(n) of the row with that number: the first groups hold one row more if n does not divide the rows."""
    least, more = F.floor(of / n), of % n
    large = more * (least + 1)
    return F.when(number <= large, F.floor((number - 1) / (least + 1)) + 1).otherwise(more + F.floor((number - 1 - large) / F.greatest(least, F.lit(1))) + 1).cast("long")
