from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute

from siltstone.llm import jaccard_join as jj
from siltstone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, node string, n int, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", 0, "clash") for i, t in rows], SCHEMA).repartition(parts)


def got(df, **how):
    out = jj.jaccard_groups(df, **how)
    assert out.columns == ["id", "n_shingles", "component"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op11_jaccard_join"](spark, sf_dir)) == expected(sf_dir, ORACLES["op11_jaccard_join"])


def near(rng, n, base=120, changes=12):
    words = [f"w{rng.randrange(4000)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w[: rng.randrange(len(w) - 10, len(w) + 1)]))
    return out


def odd_rows(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \t", "one", "One", "a b c d", "a b c d e", "A B C D E", "a b c d e f", "ÄB c d e f", "äb c d e f", "word " * 9000, "word " * 9001]
    texts += near(rng, 60) + near(rng, 30, 40, 4) + near(rng, 25, 9, 2)
    texts += [f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.choice([3, 10, 60])))}" for _ in range(60)]
    texts += [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = [(rng.randrange(10**6), t) for t in texts]
    rows += rows[20:40] + [(None, texts[14]), (None, texts[15]), (None, "alone without an id"), (None, None), (rows[15][0], "another text of one id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [80, 60])
def test_odd_rows_equal_brute_force(spark, least):
    rows = odd_rows(least)
    assert got(frame(spark, rows), least=least) == brute(rows, least)


def test_small_squares_ranges_and_hot_shingles(spark, monkeypatch):
    """Many blocks and ranges, every shingle sent row by row, and buckets that hubs alone don't settle."""
    from siltstone.llm import near_dedup

    rows = odd_rows(7)
    for module in (jj, near_dedup):
        monkeypatch.setattr(module, "SQUARE", 5)
    for name, value in (("HUB_ROUNDS", 1), ("PACKED", 40), ("RANGE_ENTRIES", 50), ("MEMBERS", 5)):
        monkeypatch.setattr(jj, name, value)
    want = brute(rows, 80)
    assert got(frame(spark, rows), least=80) == want
    monkeypatch.setattr(jj.buckets, "__defaults__", (0,))  # all shingles count as hot
    monkeypatch.setattr(jj, "HUB_ROUNDS", 0)
    assert got(frame(spark, rows), least=80) == want


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(frame(spark, [(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


def test_merge_on_a_heap_counts_lists():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 25))]
        counts = Counter(x for rows in lists for x in rows)
        for need in (1, 2, 5, 12, 25):
            assert list(jj.merge_skip(lists, need)) == sorted((x, c) for x, c in counts.items() if c >= need)


def test_partners_equal_plain_intersections(monkeypatch):
    rng = np.random.default_rng(6)
    for mu in (jj.MU, 10.0, 1e-9):  # many long lists, few, all
        monkeypatch.setattr(jj, "MU", mu)
        for _ in range(40):
            base = rng.choice(400, 60, replace=False)
            sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(0, 400, 60), base)[: rng.integers(1, 61)]) for _ in range(30)]
            sets.sort(key=len)
            index = jj.Lists(sets)
            for least in (50, 80, 100):
                for q in sets[::5]:
                    linked = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= least * len(np.union1d(q, s))]
                    allowed = rng.random(30) < 0.5
                    assert sorted(jj.partners(q, index, least, np.ones(30, dtype=bool))) == linked
                    assert sorted(jj.partners(q, index, least, allowed)) == [i for i in linked if allowed[i]]
