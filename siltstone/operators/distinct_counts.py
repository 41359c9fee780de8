"""Distinct counts of whole numbers that merge: a bitmap a bucket of 32,768 numbers, kept by period, from which the
counts of longer periods follow without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """The keys, bucket and bits of the numbers that occur. Tasks set bits before anything is shuffled, and what is
    shuffled is 4 kB for each key and bucket. Null numbers don't occur; negative ones have buckets of their own."""
    bucket, place = F.bitmap_bucket_number(df[number]), F.bitmap_bit_position(df[number])
    rows = df.where(df[number].isNotNull()).select(*(df[k].alias(k) for k in keys), bucket.alias("bucket"), place.alias("place"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def merged(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of fewer keys, or of keys that columns of maps were changed to."""
    return maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """The keys and the exact number of distinct numbers. Merges maps with equal keys first."""
    one = merged(maps, keys)
    return one.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
