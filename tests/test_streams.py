"""Late and shuffled events, and state that several triggers share."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest

from siltstone.sources import tables
from siltstone.streaming import events as streams

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, tmp_path):
    """events.parquet of three files, which triggers take in order; the second holds events long past."""
    rng = random.Random(3)
    files = [[(n * 100 + i, T0 + timedelta(minutes=(0, 2, 600)[n] + rng.uniform(0, 300)), i % 4, "click", 1.0, "{}") for i in range(60)] for n in (0, 2, 1)]
    for n, rows in enumerate(files):
        rng.shuffle(rows)
        at = tmp_path / "new"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at))
        os.makedirs(tmp_path / "events.parquet", exist_ok=True)
        part = next(p for p in at.iterdir() if p.suffix == ".parquet")
        part.rename(tmp_path / "events.parquet" / f"part-{n}.parquet")
        os.utime(tmp_path / "events.parquet" / f"part-{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))
        for p in sorted(at.rglob("*"), reverse=True):
            p.unlink()
        at.rmdir()
    return str(tmp_path), files


def test_late_events_are_dropped_beyond_the_watermark(spark, folder):
    path, files = folder
    out = streams.latest(streams.finished(streams.tumbling(streams.stream(spark, path, files=1)), "update"), ["w", "event_type"])
    got = {r.w.start: r.n for r in out.collect()}
    hour = lambda r: r[1].replace(minute=0, second=0, microsecond=0)
    limit = max(r[1] for r in files[0]) - timedelta(minutes=10)  # a trigger drops what the one before the last had closed
    late = [r for r in files[2] if hour(r) + timedelta(hours=1) > limit]
    assert got == Counter(map(hour, files[0] + files[1] + late)) and len(late) < len(files[2]) / 2


def test_state_is_carried_over_triggers(spark, folder):
    path, files = folder
    days = streams.with_disk_state(spark, lambda: streams.finished(streams.active_days(streams.stream(spark, path, files=1)), "update"))
    got = {r.user_id: (r.days, r.busiest) for r in streams.latest(days, ["user_id"]).collect()}
    per = Counter((r[2], r[1].date()) for rows in files for r in rows)
    assert got == {u: (sum(k[0] == u for k in per), max(n for k, n in per.items() if k[0] == u)) for u in range(4)}
    assert days.select("trigger").distinct().count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name):
            return None

    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getConf = staticmethod(Conf)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        tables.shared_folder(Session(), "x")


def test_repeated_events_come_once(spark, tmp_path):
    rows = [(i % 20, T0 + timedelta(minutes=i % 20), i, "click", 1.0, "{}") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = streams.finished(streams.first_of_each(streams.stream(spark, str(tmp_path), files=1), ["event_id"])).collect()
    assert sorted(r.event_id for r in out) == list(range(20))


def write_in_order(spark, tmp_path, files):
    """events.parquet of one file each, which triggers take in this order."""
    os.makedirs(tmp_path / "events.parquet", exist_ok=True)
    for n, rows in enumerate(files):
        at = tmp_path / f"new-{n}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at))
        part = next(p for p in at.iterdir() if p.suffix == ".parquet")
        part.rename(tmp_path / "events.parquet" / f"part-{n}.parquet")
        os.utime(tmp_path / "events.parquet" / f"part-{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))


@pytest.mark.parametrize("how", ["leftOuter", "inner"])
def test_streams_meet_across_triggers_in_any_order(spark, tmp_path, how):
    """Rows up to nine minutes out of order are joined, whichever side comes first; an hours-late one is not, and what
    the watermark has not passed is held back."""
    from siltstone.streaming import joins as stream_joins

    rng = random.Random(8)
    rows = [(i, T0 + timedelta(seconds=rng.randrange(12 * 3600)), rng.choice([1, 2, 3, None]), rng.choice(["click", "purchase"]), 1.0, "{}") for i in range(300)]
    rows += [(1000, T0 + timedelta(hours=12), 9, "click", 1.0, "{}"), (1001, T0 + timedelta(hours=12), 9, "purchase", 1.0, "{}"), (1002, None, 1, "click", 1.0, "{}")]
    arrival = sorted(rows, key=lambda r: (r[1] or T0) + timedelta(seconds=rng.randrange(540)))
    late = (2000, T0, 1, "click", 1.0, "{}")
    write_in_order(spark, tmp_path, [arrival[:120], arrival[120:210], [*arrival[210:], late]])

    def side(kind, name):
        events = streams.stream(spark, str(tmp_path), files=1).where(f"event_type = '{kind}'")
        return events.selectExpr("user_id", f"event_id as {name}_id", f"at as {name}_at")

    def run():
        return streams.finished(stream_joins.followed_within(side("click", "click"), side("purchase", "buy"), "user_id", "click_at", "buy_at", 1800, "10 minutes", "10 minutes", how))

    got = streams.with_settings(spark, stream_joins.STATE, run).collect()
    clicks, buys = ([r for r in rows if r[3] == k and r[1]] for k in ("click", "purchase"))
    pairs = {(c[0], b[0]) for c in clicks for b in buys if c[2] is not None and c[2] == b[2] and timedelta(0) <= b[1] - c[1] <= timedelta(minutes=30)}
    watermark = T0 + timedelta(hours=12) - timedelta(minutes=10)
    alone = {(c[0], None) for c in clicks if c[0] not in {x for x, _ in pairs} and c[1] + timedelta(minutes=30) < watermark}
    assert sorted(((r.click_id, r.buy_id) for r in got), key=str) == sorted(pairs | (alone if how == "leftOuter" else set()), key=str)
    assert len(pairs) > 20 and len(alone) > 5


def test_funnels_are_settled_by_timers_in_any_order(spark, tmp_path):
    """Events up to nine minutes out of order over four triggers; a plain look ahead settles the same views."""
    from siltstone.streaming.funnel import funnels

    rng = random.Random(9)
    rows = [(i, T0 + timedelta(seconds=rng.randrange(24 * 3600)), rng.choice([1, 2, None]), rng.choice(["view", "click", "purchase", "error"]), 1.0, "{}") for i in range(400)]
    rows += [(1000, T0 + timedelta(hours=24), 3, "view", 1.0, "{}"), (1001, None, 1, "view", 1.0, "{}")]
    arrival = sorted(rows, key=lambda r: (r[1] or T0) + timedelta(seconds=rng.randrange(540)))
    late = (2000, T0, 1, "click", 1.0, "{}")
    write_in_order(spark, tmp_path, [arrival[:100], arrival[100:300], arrival[300:380], [*arrival[380:], late]])
    got = streams.with_disk_state(spark, lambda: streams.finished(funnels(streams.stream(spark, str(tmp_path), files=1), 1800)))
    within, want = timedelta(minutes=30), []
    watermark = T0 + timedelta(hours=24) - timedelta(minutes=10)

    def following(kind, user, at):
        found = sorted((r[1], r[0]) for r in rows if r[3] == kind and r[2] == user and r[1] is not None and at < r[1] <= at + within)
        return found[0] if found else None

    for i, at, user, kind, *_ in rows:
        if kind == "view" and user is not None and at is not None and at + 2 * within <= watermark:
            click = following("click", user, at)
            buy = following("purchase", user, click[0]) if click else None
            want.append((user, i, click and click[1], buy and buy[1]))
    assert sorted(((r.user_id, r.view_id, r.click_id, r.buy_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[3] is not None for w in want) > 5 and sum(w[2] is None for w in want) > 5
    assert got.select("trigger").distinct().count() > 1  # settled as the watermark passes, not at the end
