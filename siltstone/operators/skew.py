"""A join whose hot keys, found by a frequency sketch, are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch tracks and that may count as hot; a key is hot from this many rows and this share of a task on.
TRACKED, MOST_HOT, LEAST_ROWS, TASK_SHARE = 16_384, 1_000, 10_000, 0.5


def whole(df: DataFrame) -> Column:
    """A row of df as one column."""
    return F.struct(*(df[c] for c in df.columns))


def heavy_keys(hashes: DataFrame, tasks: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """hash and copies of the keys (column hash) that hold more than their share of a task's rows, and over how many
    tasks they should be dealt. One pass with a sketch of bounded size, whose result of at most MOST_HOT rows goes to
    the driver; a key of more rows than 1 of 4,000 is always seen."""
    found = hashes.agg(F.count("hash").alias("n"), F.call_function("approx_top_k", F.col("hash"), F.lit(MOST_HOT), F.lit(TRACKED)).alias("top")).first()
    share = max(least_rows, (found.n or 0) * TASK_SHARE / tasks)
    rows = [(x["item"], -(-x["count"] // int(share)) + 1) for x in found.top or [] if x["item"] is not None and x["count"] > share]
    return hashes.sparkSession.createDataFrame(rows, "heavy long, copies int")


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least_rows: int = LEAST_ROWS) -> DataFrame:
    """left joined to right on a key, with the rows of hot left keys dealt to several tasks and only the right rows of
    these keys sent to each of them. `how` is inner, left, left_semi or left_anti.

    Null keys match nothing and are spread like the rest. Equal rows of a hot key are spread by the input partition
    that holds them, so a lost task gives the same rows again. Columns but the key must differ between the sides;
    else any names are safe. Columns travel one by one, under names of their own: a condition on the result is then
    tested on plain values within the join, where many pairs may meet.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64(whole(left)).bitwiseXOR(F.spark_partition_id() * 2654435761)
    own, others = ([c for c in df.columns if c != key] for df in (left, right))
    l = left.select(left[key].alias("key"), *(left[c].alias(f"left{i}") for i, c in enumerate(own)), place.alias("place"))  # noqa: E741
    heavy = F.broadcast(heavy_keys(l.select(F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("hash")), tasks, least_rows))
    l = l.join(heavy, F.xxhash64("key") == F.col("heavy"), "left")  # noqa: E741
    salt = F.when(F.col("key").isNull(), F.pmod("place", F.lit(tasks))).otherwise(F.coalesce(F.pmod(F.col("place"), F.col("copies")), F.lit(0)))
    l = l.withColumn("salt", salt.cast("int")).drop("place", "heavy", "copies")  # noqa: E741
    r = right.select(right[key].alias("key"), *(right[c].alias(f"right{i}") for i, c in enumerate(others)))
    r = r.join(heavy, F.xxhash64("key") == F.col("heavy"), "left")
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1))).drop("heavy", "copies")
    joined = l.join(r, ["key", "salt"], how)
    out = [F.col("key" if c == key else f"left{own.index(c)}").alias(c) for c in left.columns]
    return joined.select(*out, *(F.col(f"right{i}").alias(c) for i, c in enumerate(others) if how in ("inner", "left")))
