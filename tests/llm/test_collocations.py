from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import collocations as co
from siltstone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def brute(rows, least, longest, inside, top):
    """Counts in dictionaries, exact integers, every longer phrase looked at."""
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if a * 100 >= inside * phrases[p[i : i + m]]:
                        gone.add(p[i : i + m])
        scored = []
        for p, a in phrases.items():
            if p not in gone:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def got(df, **rules):
    out = co.collocations(df, co.Rules(**rules))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["of", "The", "a", "b", "Äb", "日本", "x y", "new", "york", "city", "q" * 300] + [f"w{i}" for i in range(60)]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b", "!"]
    text = lambda: "".join(rng.choice(vocabulary[: rng.choice([4, 10, 71])]) + rng.choice(ends) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "en", "und", None, "日"]), "clash", 0) for i in range(n)]
    return rows + rows[:9] + [(1, None, "en", "", 0), (None, "", None, "", 0), (2, "new york " * 20_000, "en", "", 0), (3, ". , ! \r\n", "dots", "", 0)]


def test_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op12_collocations"](spark, sf_dir)) == expected(sf_dir, ORACLES["op12_collocations"])


@pytest.mark.parametrize("rules", [dict(least=4, longest=5, inside=100, top=2000), dict(least=3, longest=4, inside=60, top=7)])
def test_odd_rows_equal_brute_force(spark, rules):
    rows = corpus(1)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), **rules) == brute(rows, **rules)


def test_many_words_meet_their_numbers_in_a_join(spark, monkeypatch):
    rows = corpus(2, 80)
    monkeypatch.setattr(co.coded, "__defaults__", (3,))
    assert got(spark.createDataFrame(rows, SCHEMA), least=3) == brute(rows, 3, 5, 100, 2000)


def test_small_buffers_and_ranges(spark, monkeypatch):
    rows = corpus(3, 120)
    for name, value in (("WORDS_HELD", 20), ("SORTED", 50), ("ENTRIES", 30), ("RANGE_ENTRIES", 100)):
        monkeypatch.setattr(co, name, value)
    assert got(spark.createDataFrame(rows, SCHEMA), least=3) == brute(rows, 3, 5, 100, 2000)


def test_no_rows_and_nothing_frequent(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, "a b c", "en", "", 0)], SCHEMA)) == []


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 2, 7, 16, 25])
def test_filters_lose_nothing(order, bits):
    rng = np.random.default_rng(order * 100 + bits)
    words = rng.integers(0, 1 << bits, (3000, order))
    words[:1000] = words[rng.integers(0, 20, 1000)]
    width = co.half_bits(order, bits)
    n = rng.integers(1, 400, len(words)) * rng.choice([1, 10**12], len(words))
    hi, lo = co.permuted(*co.packed(words, bits), width)
    assert (co.unpacked(*co.unpermuted(hi, lo, width), order, bits) == words).all()
    want = Counter()
    for w, c in zip(words.tolist(), n.tolist(), strict=True):
        want[tuple(w)] += c
    halves = [co.QuotientFilter.counting(hi[s], lo[s], n[s], width) for s in (slice(0, 1700), slice(1700, None))]
    whole = co.QuotientFilter.merged(halves)
    for prefix in (0, min(width, 3), min(width, 9)):
        parts = [(i, f.to_bytes(prefix)) for i, f in whole.cut(prefix)]
        back = [co.QuotientFilter.from_bytes(raw) for _, raw in parts]
        assert all((f.hi >> co.U(width - prefix) == i).all() for (i, _), f in zip(parts, back, strict=True))
        found = {}
        for f in back:
            ids = co.unpacked(*co.unpermuted(f.hi, f.lo, width), order, bits)
            found |= dict(zip(map(tuple, ids.tolist()), f.n.tolist(), strict=True))
        assert found == want
