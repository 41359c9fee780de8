"""Streams of events: windows with a watermark, sessions, deduplication, and keyed state.

A query reads its input as a stream, takes all that is available in triggers of a bounded number of files,
and keeps its offsets and state in the shared folder, so a lost executor or a restart repeats no work that
was committed. Results go to Parquet files of which each trigger writes its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import shared_folder, table

#: Files that a trigger takes.
FILES = 64

#: Keyed state is kept on the executors' disks.
DISK_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = FILES) -> DataFrame:
    """The table as a stream; event times as timestamps, which watermarks need."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is available and return its results; of a row that several triggers wrote
    (update mode) each version."""
    spark = df.sparkSession
    out, at = shared_folder(spark, "stream"), shared_folder(spark, "stream-checkpoint")
    spark.createDataFrame([], df.schema).withColumn("trigger", F.lit(0).cast("long")).write.parquet(f"{out}/none")

    def emit(rows: DataFrame, trigger: int) -> None:
        rows.withColumn("trigger", F.lit(trigger).cast("long")).write.mode("overwrite").parquet(f"{out}/{trigger}")

    df.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()
    return spark.read.parquet(f"{out}/*")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; update mode emits a window again whenever it changes."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key; append mode emits one when the watermark has passed its end, so those that may still grow
    are held back."""
    rows = events.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("w"))
    return rows.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n")).drop("w")


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row that the last trigger wrote."""
    values = [c for c in results.columns if c not in (*keys, "trigger")]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger").alias("v"))
    return best.select(*keys, *(F.col(f"v.{c}").alias(c) for c in values))


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events whose key has not been seen within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


class Days(StatefulProcessor):
    """By user: on how many days there were events, and how many on the busiest. The state is a number for each day,
    read and written once a trigger, so neither the order nor the batches in which a trigger's events come matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "day array<int>, events array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        counts = Counter(day for batch in rows for day in batch["day"].tolist())
        if (old := self.days.get()) is not None:
            counts.update(dict(zip(old[0], old[1], strict=True)))
        self.days.update((list(counts), list(counts.values())))
        yield pd.DataFrame({"user_id": [key[0]], "days": [len(counts)], "busiest": [max(counts.values())]})

    def close(self) -> None:
        pass


def active_days(events: DataFrame) -> DataFrame:
    """user_id, days and busiest, emitted again whenever a user has new events. Events without a time count for no
    day."""
    rows = events.where("ts is not null").select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return rows.groupBy("user_id").transformWithStateInPandas(Days(), "user_id bigint, days bigint, busiest bigint", "Update", "None")


def with_settings(spark: SparkSession, settings: dict[str, str], run: Callable[[], DataFrame]) -> DataFrame:
    """What run() returns, with the session's settings changed meanwhile and put back afterwards."""
    old = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return run()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def with_disk_state(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """What run() returns, with the session's keyed state on the executors' disks meanwhile."""
    return with_settings(spark, DISK_STATE, run)
