"""JSON files in which some lines are broken and whose columns change over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import MICROSECONDS

#: The column that holds a line which is no record of the schema.
BROKEN = "_broken_line"


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and the lines (column `line`) that are none or whose values don't fit the schema:
    each line is in one of the two. Files of an older version lack columns, which are null; columns that the schema
    doesn't name are left out. Empty lines are neither."""
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, **MICROSECONDS}
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", wide, options).alias("record"))
    broken = F.col("record").isNull() | F.col(f"record.{BROKEN}").isNotNull()
    return rows.where(~broken).select(*(F.col("record")[f.name].alias(f.name) for f in schema)), rows.where(broken).select(F.col("value").alias("line"))


def read_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of several versions with the columns of all of them, null where a version has none. A column
    whose type differs between versions raises."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
