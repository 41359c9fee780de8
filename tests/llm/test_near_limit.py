from __future__ import annotations

import random

import corpus_pipeline
import pytest
from siltstone.llm import near_dedup

SCHEMA = "doc_id long, text string"


def pairs_at(similarities, words=400):
    """Pairs (2 k, 2 k + 1) of texts; the second of each shares about that part of its shingles with the first."""
    rng, rows = random.Random(11), []
    for k, s in enumerate(similarities):
        base = [f"p{k}w{i}" for i in range(words)]
        cut = round(words * (1 - s))  # another ending: words - cut - 4 shingles are shared
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: words - cut] + [f"p{k}x{i}" for i in range(round(cut * rng.uniform(0, 0.2)))]))]
    return rows


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, least):
    """Component of each document; every second document has one possible partner."""
    out = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        out |= {i: i, j: i if 100 * len(x & y) >= least * len(x | y) else j}
    return out


ROWS = pairs_at([0.75, 0.78, 0.8, 0.81, 0.82, 0.83, 0.84, 0.86, 0.9] * 12)


@pytest.mark.parametrize("least", [80, 85])
def test_groups_at_a_limit(spark, least):
    want = brute(ROWS, least)
    assert (want == brute(ROWS, 85)) == (least == 85)
    got = near_dedup.near_groups(spark.createDataFrame(ROWS, SCHEMA), least=least)
    assert {r.id: r.component for r in got.collect()} == want


def test_squares_at_a_limit(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "SQUARE", 3)
    rng, rows = random.Random(3), []
    for i in range(40):
        text = [f"w{n}" for n in range(150)]
        for _ in range(rng.randrange(6)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets, want = [shingles(t) for _, t in rows], list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = want[a], want[b]
                want = [min(x, y) if c in (x, y) else c for c in want]
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA), least=80)
    assert {r.id: r.component for r in got.collect()} == dict(enumerate(want))


def test_stage_takes_its_limit(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "LEAST_SIMILARITY", 80)
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(ROWS, SCHEMA), "")
    assert {r.doc_id for r in out.collect()} == {d for d, c in brute(ROWS, 80).items() if d == c}


def test_what_follows_from_the_limit():
    assert [(x.bands, x.slots, x.agree) for x in map(near_dedup.Limit, (80, 85))] == [(37, 185, 121), (25, 125, 87)]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            near_dedup.Limit(bad)


@pytest.mark.parametrize(("least", "square", "room"), [(85, 4, 1 << 20), (80, 500, 4000), (100, 3, 1 << 20)])
def test_squares_of_size_classes(spark, monkeypatch, least, square, room):
    """Prefixes of one text: sizes over several classes, links across neighbouring ones, blocks bounded in bytes."""
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "SQUARE", square)
    monkeypatch.setattr(near_dedup, "SQUARE_BYTES", room)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(70):
        text = base[: rng.randrange(60, 400)]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets, want = [shingles(t) for _, t in rows], list(range(70))
    for a in range(70):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = want[a], want[b]
                want = [min(x, y) if c in (x, y) else c for c in want]
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA), least=least)
    assert {r.id: r.component for r in got.collect()} == dict(enumerate(want))


def test_classes_of_sizes_that_may_link(spark):
    from pyspark.sql import functions as F

    for least in (80, 85):
        limit = near_dedup.Limit(least)
        pairs = spark.range(1, 3000).select(F.col("id").alias("a"), F.floor(F.col("id") * 100 / least).alias("b"))
        gap = pairs.select(near_dedup.size_class(F.col("b"), limit) - near_dedup.size_class(F.col("a"), limit))
        assert {r[0] for r in gap.distinct().collect()} <= {0, 1}
