"""Ranges as dyadic blocks: of two to the power of `level` numbers each, so that any range of numbers is some blocks
and a number lies in one block of every level. A join on blocks then brings each number together with each range that
holds it exactly once, whether the range is a second or a century long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import skewed_join

#: Numbers that blocks are made of: from -2**(BITS - 1) to below 2**(BITS - 1). Values beyond count as the last ones.
BITS = 42

#: A block of a level is as many of the level below as two to the power of STEP: points go to every level, so that few
#: levels keep their rows few. A level is the number of bits of its blocks.
STEP = 4
LEVELS = range(0, BITS + 1, STEP)


def number(value: Column, width: float) -> Column:
    """The number of the step of `width` that holds a value, from 0 on; values far out and not-a-number are in the
    first or last one."""
    half = 1 << BITS - 1
    steps = F.least(F.greatest(value.cast("double") / width, F.lit(float(-half))), F.lit(float(half - 1)))
    return F.floor(steps).cast("long") + half


def _block(level: int, block: Column) -> Column:
    """A block of a level as one number."""
    return block + (level << BITS)


def _level(low: Column, high: Column, level: int) -> tuple[Column, Column]:
    """Of the blocks of a level that lie within low to high, the first, and the one after the last."""
    return F.call_function("shiftright", low + ((1 << level) - 1), F.lit(level)), F.call_function("shiftright", high + 1, F.lit(level))


def cover(low: Column, high: Column, levels: Sequence[int] = LEVELS) -> Column:
    """The disjoint blocks of these levels that make up the numbers from low to high, 30 a level at most; none if high
    is below low. The levels are the first ones of LEVELS, up to that of the range or beyond."""

    def at(level: int) -> list[Column]:
        (a, b), (above, below) = _level(low, high, level), _level(low, high, level + STEP)
        wide = F.lit(level < LEVELS[-1]) & (above < below)
        head, tail = F.when(wide, F.call_function("shiftleft", above, F.lit(STEP))).otherwise(b), F.call_function("shiftleft", below, F.lit(STEP))
        none = F.array().cast("array<bigint>")
        runs = F.when(a < head, F.sequence(a, head - 1)).otherwise(none), F.when(wide & (tail < b), F.sequence(tail, b - 1)).otherwise(none)
        return [F.transform(run, lambda x: _block(level, x)) for run in runs]

    return F.flatten(F.array(*(run for level in levels for run in at(level))))


def _used(ranges: DataFrame) -> list[int]:
    """The levels up to that of the longest range, which is 0 if there is none."""
    longest = ranges.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0]
    return [level for level in LEVELS if level == 0 or (longest or 0) >> level]


def within(points: DataFrame, ranges: DataFrame, same: Sequence[str] = ()) -> DataFrame:
    """points (number and the columns `same`) joined with the ranges (low, high and `same`) that hold the number,
    columns `same` being equal; the other columns of both, which differ in name. Numbers are sent once for each level
    up to that of the longest range; a block that holds a large share of them is dealt to several tasks."""
    levels = _used(ranges)
    point, held = ([c for c in df.columns if c not in (*same, *own)] for df, own in ((points, ("number",)), (ranges, ("low", "high"))))
    blocks = ranges.withColumn("at", F.explode(cover(F.col("low"), F.col("high"), levels)))
    each = F.array(*(_block(level, F.call_function("shiftright", F.col("number"), F.lit(level))) for level in levels))
    spread = points.withColumn("at", F.explode(each))
    name = (F.struct(*same, "at") if same else F.col("at")).alias("block")
    known = F.lit(True)
    for c in same:
        known &= F.col(c).isNotNull()
    return skewed_join(spread.where(known).select(name, *point), blocks.where(known).select(name, *held), "block").select(*point, *held)
