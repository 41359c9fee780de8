"""Columns for money, vectors, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(column: Column | str) -> Column:
    """A double of two decimals as an exact decimal: sums then don't depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return money(price) * (F.lit(1).cast("decimal(3,2)") - F.col(discount).cast("decimal(3,2)"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def json_long(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("long")


def masked_emails(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")


def variant_leaves(df: DataFrame, column: str, depth: int = 8) -> DataFrame:
    """path and value (a variant) of every field below the variants of a column, to a depth at which what is left
    stays whole. A field of an object is `.name` in the path, an element of an array `[]`. Nulls of either kind,
    empty objects and plain values at the top have no fields; a null field has no value and is left out."""
    level = df.select(F.lit("$").alias("path"), df[column].alias("value"))
    out = None
    for step in range(depth):
        each = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("inner")))
        below = each.select(F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.lit("[]"))).alias("path"), F.col("inner").alias("value"))
        below = below.where(F.col("value").isNotNull() & ~F.is_variant_null("value"))
        nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<") & F.lit(step < depth - 1)
        leaves = below.where(~nested)
        out = leaves if out is None else out.unionByName(leaves)
        level = below.where(nested)
    return out
