"""Tables laid out for their joins: bucketed by key, so that joins of two tables need no exchange, and partitioned, so
that a filter on a joined table prunes files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .tables import shared_folder


@contextmanager
def laid_out(df: DataFrame, name: str, buckets: int = 0, key: str = "", partition_by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """df as a table below the shared folder, under a name of its own, which the catalog has while the block is open.
    The files stay. A null key is in one bucket like any other; a null partition value is one of its own."""
    spark: SparkSession = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("path", shared_folder(spark, name))
    if buckets:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"drop table if exists {table}")


def by_bucket(df: DataFrame, name: str, buckets: int, key: str, partition_by: Sequence[str] = ()):
    """laid_out() with the rows of a bucket dealt to one task first, so that a bucket is one file."""
    return laid_out(df.repartition(buckets, key), name, buckets, key, partition_by)
