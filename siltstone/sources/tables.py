"""Tables of a scale-factor folder, and files in the formats that Spark has built in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Text formats keep three digits of a second unless told otherwise.
MICROSECONDS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a temporary one
    where the setting is absent and the master is local, as executors elsewhere would not see it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder once and read back: later steps neither compute it again nor depend on an
    executor that may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, kind: str, partition_by: Sequence[str] = ()) -> None:
    """df as parquet, orc, json or csv files below path."""
    options = MICROSECONDS if kind in ("json", "csv") else {}
    options = options | ({"header": "true", "escape": '"'} if kind == "csv" else {})
    df.write.partitionBy(*partition_by).options(**options).format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """Files of write(), with the schema given: nothing is inferred from the data."""
    options = MICROSECONDS if kind in ("json", "csv") else {}
    options = options | ({"header": "true", "escape": '"'} if kind == "csv" else {})
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def round_trip(df: DataFrame, kind: str, partition_by: Sequence[str] = ()) -> DataFrame:
    path = shared_folder(df.sparkSession, kind)
    write(df, path, kind, partition_by)
    return read(df.sparkSession, path, kind, df.schema).select(*df.columns)
