"""All ancestors in a forest by pointer doubling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .skew import skewed_join


#: Pairs from which on a hot ancestor is looked for; fewer are a task's work anyway.
LOOK_FOR_HOT = 200_000


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor and distance (from 1) for all ancestors of every child, with as many rounds as the depth has
    binary digits.

    First the jumps double: those of round k lead 2**k steps up, until none leads further. Then the pairs grow by
    them: pairs of up to 2**k steps, moved on by a jump of 2**k steps, are those of up to 2**(k + 1) steps that were
    not there before, so no pair is made twice or compared with another. Both are written and read again in each
    round; an ancestor of many is joined as a hot key.

    A child with a null parent is a root, as is what is no child. Equal edges count once; edges with a null child
    are left out. A child with two parents or a cycle raises ValueError. No edges give no rows.
    """
    step = edges.select(edges[child].alias("node"), edges[parent].alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    jumps = [staged(step, "closure-jumps")]
    total, children = jumps[0].agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if total != children:
        raise ValueError("a child has two parents")
    while not jumps[-1].isEmpty():
        if 1 << len(jumps) - 1 > children:
            raise ValueError("the edges have a cycle")
        jumps.append(staged(_moved(jumps[-1], jumps[-1]), "closure-jumps"))
    pairs = [jumps[0].withColumn("distance", F.lit(1).cast("long"))]
    for k, jump in enumerate(jumps[:-1]):
        pairs.append(staged(_moved(reduce(DataFrame.unionByName, pairs), jump, 1 << k), "closure-pairs"))
    return reduce(DataFrame.unionByName, pairs)


def _moved(pairs: DataFrame, jumps: DataFrame, steps: int = 0) -> DataFrame:
    """The pairs whose ancestor has a jump, with its end as their ancestor and `steps` more in distance, if they
    have one."""
    further = jumps.select(F.col("node").alias("via"), F.col("ancestor").alias("end"))
    named = pairs.withColumnRenamed("ancestor", "via")
    moved = skewed_join(named, further, "via") if pairs.count() > LOOK_FOR_HOT else named.join(further, "via")
    distance = [(F.col("distance") + steps).alias("distance")] if "distance" in pairs.columns else []
    return moved.select("node", F.col("end").alias("ancestor"), *distance)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of start and all that `step` makes of them, again and again, each once: rounds go from what the last
    one found new, not from all that is known, and end when nothing is. Equal rows count once, nulls being equal.
    Each round's finds are written and read again."""
    known = new = staged(start.distinct(), "fixpoint")
    while True:
        made = step(new).distinct()
        on = reduce(and_, (made[c].eqNullSafe(known[c]) for c in known.columns))
        new = staged(made.join(known, on, "left_anti"), "fixpoint")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
