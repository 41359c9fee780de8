"""Joins of two streams, each with a watermark of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state of such a join is kept in one store a partition, on the executors' disks.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def followed_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int, left_late: str, right_late: str, how: str = "leftOuter") -> DataFrame:
    """left with the right rows of its key that are 0 to `seconds` later; how is inner or leftOuter.

    Both sides keep state: a left row until the watermark says that no right row in its time can still come, a right
    row until no left row can. A left row without a partner is emitted with nulls when its state goes, so the tail of
    the stream, which may still find partners, is held back. The watermark is the lesser of the two sides', each so
    far behind its latest row as its side may be late; what is later still is dropped. Null keys and null times find
    nothing; a null time never leaves, as no watermark passes it. Columns of the sides differ but for the key.
    """
    l = left.where(F.col(left_time).isNotNull()).withWatermark(left_time, left_late)  # noqa: E741
    r = right.where(F.col(right_time).isNotNull()).withColumnRenamed(key, f"{key}_of_right").withWatermark(right_time, right_late)
    gap = f"interval {int(seconds)} seconds"
    on = (F.col(key) == F.col(f"{key}_of_right")) & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(gap))
    return l.join(r, on, how).drop(f"{key}_of_right")
