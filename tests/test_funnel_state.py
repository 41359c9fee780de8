"""Keys of a funnel's state are buckets of users: calls to the state do not grow with the users."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from oracle import expected, rows

from siltstone.plans.catalog import ORACLES, QUERIES
from siltstone.streaming import funnel

MINUTE = 60_000_000


class Handle:
    """Stands for the handle and both of its states, and counts the calls."""

    def __init__(self):
        self.parts, self.ms, self.timers, self.calls = [], None, set(), 0

    def getListState(self, name, schema):
        return List(self)

    def getValueState(self, name, schema):
        return Value(self)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class List:
    def __init__(self, of):
        self.of = of

    def get(self):
        self.of.calls += 1
        return iter(self.of.parts)

    def appendValue(self, value):
        self.of.calls += 1
        self.of.parts.append(value)

    def put(self, values):
        self.of.calls += 1
        self.of.parts = list(values)

    def clear(self):
        self.put([])


class Value:
    def __init__(self, of):
        self.of = of

    def get(self):
        self.of.calls += 1
        return self.of.ms

    def update(self, value):
        self.of.calls += 1
        self.of.ms = value

    def clear(self):
        self.update(None)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def look_ahead(events, within, passed):
    def following(user, kind, us):
        found = sorted((e[3], e[2]) for e in events if e[:2] == (user, kind) and us < e[3] <= us + within)
        return found[0] if found else None

    out = set()
    for user, kind, id_, us in events:
        if kind == 0 and us + 2 * within <= passed:
            click = following(user, 1, us)
            buy = following(user, 2, click[0]) if click else None
            out.add((user, id_, click and click[1], buy and buy[1]))
    return out


@pytest.mark.parametrize("users", [1, 300])
def test_a_bucket_takes_few_calls_and_settles_each_user_alone(users):
    rng = random.Random(users)
    events = [(rng.randrange(users) * 10**15 - 5, rng.randrange(3), i, rng.randrange(600) * MINUTE) for i in range(2000)]
    handle, within = Handle(), 20 * MINUTE
    steps = funnel.Funnel(within)
    steps.init(handle)
    got, done = [], -1
    for passed in (200, 201, 450, 900):  # what comes is later than the watermark before
        new = [e for e in events if done * MINUTE < e[3] <= passed * MINUTE]
        done = passed
        frames = [pd.DataFrame(part, columns=funnel.EVENT) for part in (new[::2], new[1::2]) if part]
        if frames:
            assert list(steps.handleInputRows((0,), iter(frames), Watermark(0))) == []
        for ms in [t for t in handle.timers if t <= passed * 1000 * 60]:
            handle.timers.remove(ms)
            for df in steps.handleExpiredTimer((0,), Watermark(passed * 1000 * 60), None):
                got += [tuple(None if pd.isna(x) else int(x) for x in r) for r in df.itertuples(index=False)]
        assert set(got) == look_ahead(events, within, passed * MINUTE) and len(handle.timers) <= 1
    assert len(got) == sum(e[1] == 0 for e in events) and handle.calls <= 4 * 10
    assert not handle.parts and not handle.timers


@pytest.mark.parametrize("buckets", [1, 3])
def test_users_who_share_a_bucket(spark, sf_dir, monkeypatch, buckets):
    monkeypatch.setattr(funnel, "BUCKETS", buckets)
    assert rows(QUERIES["streamed_funnels"](spark, sf_dir)) == expected(sf_dir, ORACLES["streamed_funnels"])


def test_events_at_one_time_and_far_apart(spark, tmp_path):
    """Of clicks at one time that with the least number counts; none at the view's own time."""
    t = datetime(2024, 1, 1)
    h = timedelta(hours=1)
    found = [(1, t, 7, "view"), (2, t, 7, "click"), (5, t + 6 * h, 7, "click"), (4, t + 6 * h, 7, "click"), (3, t + 6 * h, 8, "click"), (6, t + 12 * h, 7, "purchase"), (7, t + 12 * h + timedelta(microseconds=1), 7, "purchase"), (8, t, -9, "view"), (9, t + 6 * h + timedelta(microseconds=1), -9, "click"), (10, datetime(2200, 1, 1), 7, "error"), (11, datetime(2200, 1, 1), 7, "click")]
    frame = spark.createDataFrame([(*r, 1.0, "{}") for r in found], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = rows(QUERIES["streamed_funnels"](spark, str(tmp_path)))
    assert got == sorted([("6", "4", "7", "1"), ("null", "null", "-9", "8")])
