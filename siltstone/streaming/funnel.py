"""A funnel of events that times out: list state by buckets of users, settled by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A view, the first click after it and the first purchase after that.
STEPS = ("view", "click", "purchase")

#: Users share so many keys of state, as each key costs some ten calls to the state, however few events it has. A
#: bucket holds its share of the events that may still be needed.
BUCKETS = 2048

#: An event: its user, the number of its step, its number and its time in microseconds.
EVENT = ("user", "kind", "id", "us")

Events = dict[str, np.ndarray]


class Funnel(StatefulProcessor):
    """Keeps the events of a bucket of users until the watermark is so far beyond a view that all of its funnel has
    come, whatever the order in which it came; then the view is settled, and events that no later view of their user
    can need are dropped. One timer a bucket stands, for the earliest view. The events of a trigger are one element of
    the list, so they are added without reading those before."""

    def __init__(self, within_us: int) -> None:
        self.within = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", ", ".join(f"{c} array<bigint>" for c in EVENT))
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wait_for(self, views: np.ndarray, old: int | None) -> None:
        ms = -(-(int(views.min()) + 2 * self.within) // 1000) if len(views) else None
        if ms is not None and (old is None or ms < old):
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batches = [batch[list(EVENT)] for batch in rows]
        new = {c: np.concatenate([batch[c].to_numpy("int64") for batch in batches]) for c in EVENT}
        self.events.appendValue(tuple(new[c].tolist() for c in EVENT))
        views = new["us"][new["kind"] == 0]
        if len(views):
            old = self.timer.get()
            self._wait_for(views, old[0] if old is not None else None)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.events.get())
        events = {c: np.concatenate([np.array(part[i], "int64") for part in parts]) for i, c in enumerate(EVENT)}
        order = np.lexsort([events[c] for c in ("id", "us", "user")])
        events = {c: values[order] for c, values in events.items()}
        users, user = np.unique(events["user"], return_inverse=True)
        times, time = np.unique(events["us"], return_inverse=True)
        events["place"] = user * len(times) + time  # in the order of users and times
        view = events["kind"] == 0
        waiting = view & (events["us"] + 2 * self.within > passed)
        oldest = np.full(len(users), passed)
        np.minimum.at(oldest, user[waiting], events["us"][waiting])
        kept = waiting | ~view & (events["us"] > oldest[user])
        if kept.any():
            self.events.put([tuple(events[c][kept].tolist() for c in EVENT)])
        else:
            self.events.clear()
        self.timer.clear()
        self._wait_for(events["us"][waiting], None)
        settled = {c: values[view & ~waiting] for c, values in events.items()}
        if len(settled["id"]):
            clicks, buys = ({c: values[events["kind"] == step] for c, values in events.items()} for step in (1, 2))
            at, clicked = self._next(clicks, settled)
            bought = np.zeros(len(clicked), bool)
            buy = np.zeros(len(clicked), "int64")
            buy[clicked], bought[clicked] = self._next(buys, {c: values[at[clicked]] for c, values in clicks.items()})
            found = {"user_id": pd.array(settled["user"], "Int64"), "view_id": pd.array(settled["id"], "Int64")}
            yield pd.DataFrame(found | {"click_id": _ids(clicks, at, clicked), "buy_id": _ids(buys, buy, bought)})

    def _next(self, events: Events, after: Events) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of `after` the number of the next of the events of its user, and whether that is in time. The
        events are in the order of users, times and numbers."""
        at = np.searchsorted(events["place"], after["place"], "right")
        found = at < len(events["place"])
        next_one = {c: events[c][at[found]] for c in ("user", "us")}
        found[found] = (next_one["user"] == after["user"][found]) & (next_one["us"] <= after["us"][found] + self.within)
        return at, found

    def close(self) -> None:
        pass


def _ids(events: Events, at: np.ndarray, found: np.ndarray) -> pd.api.extensions.ExtensionArray:
    """The numbers of the events at these places, null where there is none."""
    ids = np.zeros(len(at), "int64")
    ids[found] = events["id"][at[found]]
    return pd.arrays.IntegerArray(ids, ~found)


def funnels(events: DataFrame, within_seconds: int, late: str = "10 minutes") -> DataFrame:
    """user_id, view_id, click_id and buy_id of each view: the first click after it and the first purchase after that
    click, each within the time, or null where the funnel timed out. Views that may still go on are held back. Events
    without a user or a time take no part, nor do those that are later than `late`."""
    known = events.where(F.col("user_id").isNotNull() & F.col("at").isNotNull() & F.col("event_type").isin(*STEPS)).withWatermark("at", late)
    step = F.array_position(F.array(*map(F.lit, STEPS)), F.col("event_type")) - 1
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket")
    rows = known.select("at", bucket, F.col("user_id").alias("user"), step.alias("kind"), F.col("event_id").alias("id"), F.unix_micros("at").alias("us"))
    out = "user_id bigint, view_id bigint, click_id bigint, buy_id bigint"
    return rows.groupBy("bucket").transformWithStateInPandas(Funnel(within_seconds * 1_000_000), out, "Append", "EventTime")
