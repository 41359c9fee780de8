"""Exact quantiles of groups by distributed selection.

Each round narrows every wanted rank to an open interval of values. A sketch of bounded size gives splitting points of
the rows in the interval, from which two are taken that should enclose the rank; an exact count then says whether the
rank falls below, on, between or above them. It is found if it falls on one of them, as it does with many ties; else
one of three intervals is left, which holds a hundredth of the rows or so. Intervals of few rows are sorted. What a
task holds is a sketch, or those few rows, whatever the number of rows, of groups or of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Splitting points of a round; accuracy of the sketch; rows of an interval that are sorted.
SPLITS, ACCURACY, FEW = 256, 4096, 4096

#: Intervals that are broadcast; more belong to so many groups that a shuffle deals them out.
SENT = 100_000


def _same(keys: list[str]) -> Column:
    return reduce(lambda on, k: on & F.col(k).eqNullSafe(F.col(f"of_{k}")), keys, F.lit(True))


def _inside(rows: DataFrame, open_: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """The rows (keys, value) with each interval (of_..., low, high, and others) of their group that holds them. Few
    intervals go to the rows: a shuffle would bring all rows of a group to one task."""
    open_ = F.broadcast(open_) if broadcast else open_
    held = (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high")))
    return rows.join(open_, _same(keys) & held).drop(*keys)


def select_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, few: int = FEW) -> DataFrame:
    """wanted (of_..., rank from 0, n: rows of the group) with `found`, the value of that rank among the rows (keys,
    value) of the group. No value is null, and no rank is n or more."""
    names = [f"of_{k}" for k in keys]
    kind = rows.schema["value"].dataType
    none = F.lit(None).cast(kind)
    open_ = wanted.select(*names, "rank", F.col("rank").alias("left"), F.col("n"), none.alias("low"), none.alias("high"))
    done: list[DataFrame] = []
    while True:
        few_left, more = open_.agg(F.count_if(F.col("n") <= few), F.count_if(F.col("n") > few)).first()
        if few_left:
            sorted_ = _inside(rows, open_.where(F.col("n") <= few), keys, few_left <= SENT).groupBy(*names, "rank").agg(F.sort_array(F.collect_list("value")).alias("values"), F.first("left").alias("left"))
            done.append(staged(sorted_.select(*names, "rank", F.element_at("values", F.col("left").cast("int") + 1).alias("found")), "quantile-found"))
        if not more:
            break
        open_ = open_.where(F.col("n") > few)
        intervals = open_.select(*names, "low", "high").distinct()
        shares = [i / SPLITS for i in range(SPLITS + 1)]
        splits = _inside(rows, intervals, keys, more <= SENT).groupBy(*names, "low", "high").agg(F.percentile_approx("value", shares, ACCURACY).alias("splits"))
        splits = staged(splits.select(*(F.col(c).alias(f"s_{c}") for c in [*names, "low", "high"]), "splits"), "quantile-splits")
        same = reduce(lambda on, c: on & F.col(c).eqNullSafe(F.col(f"s_{c}")), [*names, "low", "high"], F.lit(True))
        at = F.col("left") / F.col("n") * SPLITS
        take = lambda i: F.when((i >= 0) & (i <= SPLITS), F.try_element_at("splits", i.cast("int") + 1))
        guess = open_.join(splits, same).select(*open_.columns, take(F.floor(at) - 1).alias("a"), take(F.ceil(at) + 1).alias("b"))
        value, a, b = F.col("value"), F.col("a"), F.col("b")
        below, on_a = a.isNotNull() & (value < a), a.isNotNull() & (value == a)
        above, on_b = b.isNotNull() & (value > b), b.isNotNull() & (value == b) & ~on_a
        counts = [F.count_if(c).alias(name) for name, c in (("below", below), ("on_a", on_a), ("on_b", on_b), ("above", above))]
        about = [*names, "rank", "left", "n", "low", "high", "a", "b"]
        counted = _inside(rows, guess, keys, more <= SENT).groupBy(*about).agg(*counts)
        between = F.col("n") - F.col("below") - F.col("on_a") - F.col("on_b") - F.col("above")
        counted = staged(counted.withColumn("between", between), "quantile-counts")
        left = F.col("left")
        ends = [F.col("below")]
        for c in ("on_a", "between", "on_b"):
            ends.append(ends[-1] + F.col(c))
        hit = F.when((left >= ends[0]) & (left < ends[1]), a).when((left >= ends[2]) & (left < ends[3]), b)
        done.append(counted.where(hit.isNotNull()).select(*names, "rank", hit.alias("found")))
        keep = lambda n, less, low, high: F.struct(F.col(n).alias("n"), (left - less).alias("left"), low.alias("low"), high.alias("high"))
        rest = F.when(left < ends[0], keep("below", F.lit(0), F.col("low"), a)).when(left < ends[2], keep("between", ends[1], a, b)).otherwise(keep("above", ends[3], b, F.col("high")))
        open_ = counted.where(hit.isNull()).select(*names, "rank", rest.alias("rest")).select(*names, "rank", "rest.left", "rest.n", "rest.low", "rest.high")
    return reduce(DataFrame.unionByName, done) if done else wanted.select(*names, "rank", none.alias("found"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """A row for each group of the keys: the keys, n (values), and q0, q1, ..., the exact quantiles of the shares
    (0 to 1), linear between neighbouring values, as doubles.

    Nulls and not-a-number are no values; a group without values has n = 0 and null quantiles. Null keys are a group.
    No rows give none. Columns of df may have any name but those of the result.
    """
    names = [f"key{i}" for i in range(len(keys))]
    one = df.select(*(df[k].alias(n) for k, n in zip(keys, names, strict=True)), df[value].alias("value"))
    if df.schema[value].dataType.typeName() in ("double", "float"):
        one = one.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    groups = staged(one.groupBy(*names).agg(F.count("value").alias("n")), "quantile-groups")
    place = lambda s: (F.col("n") - 1) * float(s)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares))))
    wanted = groups.where("n > 0").select(*(F.col(n).alias(f"of_{n}") for n in names), F.explode(ranks).alias("rank"), "n")
    found = select_ranks(one.where("value is not null"), names, wanted, few)
    by_group = found.groupBy(*(f"of_{n}" for n in names)).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("found").cast("double").alias("v")))).alias("at"))
    rows = groups.join(by_group, _same(names), "left")

    def quantile(share: float) -> Column:
        low, high = F.col("at")[F.floor(place(share))], F.col("at")[F.ceil(place(share))]
        return low + (high - low) * (place(share) - F.floor(place(share)))

    return rows.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "n", *(quantile(s).alias(f"q{i}") for i, s in enumerate(shares)))
