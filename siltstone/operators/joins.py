"""Joins on time and ranges: as-of, interval, band, overlap. All deal rows out by key and bucket, so that a hot key is
spread over many tasks. Rows travel as one struct beside the helper columns, so columns of any name are safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dyadic import number, within
from .skew import skewed_join, whole  # noqa: F401


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], bucket_seconds: int = 86_400) -> DataFrame:
    """left with the columns `take` of the latest row of right that has its key and is not later; nulls if
    there is none. Of right rows at one time the one with the greatest `take` counts. A null key or time
    finds nothing.

    Within a bucket a window finds the latest row; the last row of each earlier bucket is carried over by
    a window on one row a bucket.
    """
    payload = F.struct(right[right_time].alias("at"), F.struct(*(right[c] for c in take)).alias("taken"))
    r = right.where(right[key].isNotNull() & right[right_time].isNotNull()).select(right[key].alias("key"), _bucket(right[right_time], bucket_seconds).alias("bucket"), right[right_time].alias("time"), F.lit(0).alias("side"), payload.alias("right"))
    l = left.select(left[key].alias("key"), _bucket(left[left_time], bucket_seconds).alias("bucket"), left[left_time].alias("time"), F.lit(1).alias("side"), whole(left).alias("left"))  # noqa: E741
    both = l.withColumn("right", F.lit(None).cast(r.schema["right"].dataType)).unionByName(r.withColumn("left", F.lit(None).cast(l.schema["left"].dataType)))
    lasts = both.groupBy("key", "bucket").agg(F.max("right").alias("last"))
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = W.partitionBy("key", "bucket").orderBy("time", "side", "right").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("right", ignorenulls=True).over(inside)).where("side = 1")
    found = found.join(carried, F.col("key").eqNullSafe(F.col("k")) & F.col("bucket").eqNullSafe(F.col("b")), "left")
    best = F.when(F.col("key").isNotNull() & F.col("time").isNotNull(), F.coalesce("found", "carried"))
    return found.select("left.*", *(best["taken"][c].alias(c) for c in take))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within_seconds: int) -> DataFrame:
    """Pairs of rows with one key where right is 0 to `within_seconds` after left. The columns of the two
    sides must differ but for the key. Left rows go to two buckets, right rows to one, so each pair meets
    once. With 0 seconds the times must be equal. Null keys and times find nothing."""
    bucket_seconds = max(1, within_seconds)
    at = _bucket(left[left_time], bucket_seconds)
    l = left.select(left[key].alias("key"), F.unix_micros(left[left_time].cast("timestamp")).alias("from"), whole(left).alias("left"), F.explode(F.array(at, at + 1)).alias("bucket"))  # noqa: E741
    others = [c for c in right.columns if c != key]
    r = right.select(right[key].alias("key"), F.unix_micros(right[right_time].cast("timestamp")).alias("to"), F.struct(*(right[c] for c in others)).alias("right"), _bucket(right[right_time], bucket_seconds).alias("bucket"))
    gap = F.col("to") - F.col("from")
    return l.join(r, ["key", "bucket"]).where((gap >= 0) & (gap <= within_seconds * 1_000_000)).select("left.*", "right.*")


def band_join(left: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a row of left and a band that holds its value, low and high included: a join without an equality.
    Values and bands meet by dyadic blocks of steps of `width`, so a band takes a few blocks however wide it is, and
    may have an infinite end. The columns of the two sides must differ; nulls, not-a-number and bands whose low is
    above their high find nothing."""
    points = left.select(F.struct(whole(left).alias("row"), left[value].alias("value")).alias("point"), number(left[value], width).alias("number"))
    packed = F.struct(whole(bands).alias("row"), bands[low].alias("low"), bands[high].alias("high")).alias("range")
    ranges = bands.where(bands[low] <= bands[high]).select(packed, number(bands[low], width).alias("low"), number(bands[high], width).alias("high"))
    held = (F.col("point.value") >= F.col("range.low")) & (F.col("point.value") <= F.col("range.high"))
    return within(points, ranges).where(held).select("point.row.*", "range.row.*")


def _spans(df: DataFrame, start: str, end: str, key: str | None, grain_seconds: float) -> DataFrame:
    """row, from and to in microseconds, their numbers, and the key, of the spans of df that have both ends."""
    micros = lambda c: F.unix_micros(df[c].cast("timestamp"))
    keys = [df[key].alias("key")] if key else []
    spans = df.select(whole(df).alias("row"), micros(start).alias("from"), micros(end).alias("to"), *keys).where("from <= to")
    return spans.withColumn("low", number(F.col("from"), grain_seconds * 1e6)).withColumn("high", number(F.col("to"), grain_seconds * 1e6))


def _begun(points: DataFrame, ranges: DataFrame, same: list[str]) -> DataFrame:
    """Spans of points that begin after a span of ranges and no later than it ends: the columns of both, with point_
    and range_ before their names. A moment holds no other, so only spans with a length are cut into blocks."""
    named = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("low", "high", *same)]
    p = points.select(*named(points, "point"), F.col("low").alias("number"), *same)
    r = ranges.where("from < to").select(*named(ranges, "range"), "low", "high", *same)
    return within(p, r, same).where("point_from > range_from and point_from <= range_to")


def _begun_together(left: DataFrame, right: DataFrame, same: list[str]) -> DataFrame:
    """Spans of left and right that begin at one moment: the columns of both, with left_ and right_ before their names."""
    known = F.lit(True)
    for c in same:
        known &= F.col(c).isNotNull()
    at = (F.struct(*same, "from") if same else F.col("from")).alias("at")
    named = lambda df, side: df.where(known).select(at, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("low", "high", *same)))
    return skewed_join(named(left, "left"), named(right, "right"), "at")


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, key: str | None = None, grain_seconds: float = 60.0, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Pairs of a row of left and a row of right whose spans of time share a moment, ends included, as two structs.

    Two spans that overlap begin together, which is a join on equal starts, or one begins later within the other. The
    latter is a join of moments with the dyadic blocks of spans, so a year-long span takes few blocks, and every pair
    meets once. With a key its values must be equal. Spans without an end, without a start or that end before they
    start find nothing, nor do null keys.
    """
    l, r = _spans(left, start, end, key, grain_seconds), _spans(right, start, end, key, grain_seconds)  # noqa: E741
    same = ["key"] if key else []
    rows = _begun_together(l, r, same).select("left_row", "right_row")
    rows = rows.union(_begun(l, r, same).select("point_row", "range_row")).union(_begun(r, l, same).select("range_row", "point_row"))
    return rows.toDF(*names)


def overlaps_among(df: DataFrame, start: str, end: str, by: str, grain_seconds: float = 60.0, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """The pairs of overlap_join(df, df, ...) in which `by` is less on the left, each looked for once: of two spans
    only the later one is sought in the earlier. Rows with a null `by` have no pairs. The columns of df are joined as
    they are, so that those which are not asked for do not travel."""
    at = [f"c{i}" for i in range(len(df.columns))]
    key = at[df.columns.index(by)]
    spans = _spans(df.where(df[by].isNotNull()), start, end, None, grain_seconds)
    spans = spans.select("from", "to", "low", "high", *(F.col("row")[c].alias(a) for c, a in zip(df.columns, at, strict=True)))
    together = _begun_together(spans, spans, []).where(F.col(f"left_{key}") < F.col(f"right_{key}"))
    begun = _begun(spans, spans, []).where(F.col(f"point_{key}") != F.col(f"range_{key}"))
    early = F.col(f"range_{key}") < F.col(f"point_{key}")

    def pair(a: list[Column], b: list[Column]) -> list[Column]:
        return [F.struct(*(x.alias(c) for x, c in zip(side, df.columns, strict=True))).alias(name) for side, name in zip((a, b), names, strict=True)]

    rows = together.select(*pair([F.col(f"left_{a}") for a in at], [F.col(f"right_{a}") for a in at]))
    first = [F.when(early, F.col(f"range_{a}")).otherwise(F.col(f"point_{a}")) for a in at]
    second = [F.when(early, F.col(f"point_{a}")).otherwise(F.col(f"range_{a}")) for a in at]
    return rows.union(begun.select(*pair(first, second)))
