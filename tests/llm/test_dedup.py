from __future__ import annotations

import random
from collections import defaultdict

from siltstone.llm import exact_dedup, near_dedup
from siltstone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, id string, n int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op7_exact_dedup"](spark, sf_dir)) == expected(sf_dir, ORACLES["op7_exact_dedup"])


ODD = [(1, None), (2, ""), (3, "Äb"), (4, "äb"), (5, "AB"), (6, "ab"), (6, "ab"), (None, "aB"), (7, "x " * 60_000), (8, "X " * 60_000), (9, " ab"), (None, "only null"), (10, "İ"), (11, "i̇")]


def test_exact_odd_rows_in_several_triggers(spark):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in ODD], SCHEMA).repartition(5)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[lowered(t)].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    got = sorted(((r.id, r.keep, r.n) for r in exact_dedup.exact_groups(df, files_per_trigger=1).collect()), key=str)
    assert got == sorted(((i, keep[lowered(t)], len(groups[lowered(t)])) for i, t in ODD), key=str)


def test_exact_bytes_decide_between_equal_digests(spark, monkeypatch):
    """With a digest of one letter, texts that collide are told apart by their bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.substring(F.md5(c), 1, 1))
    rows = [(i, f"t{i % 20}", "", 0) for i in range(60)]
    got = {(r.id, r.keep, r.n) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, 40 + i % 20, 3) for i in range(60)}


def test_exact_state_outlives_a_call(spark, tmp_path):
    """Three tables against one kept state: copies in earlier ones count, also of texts long ago."""
    from siltstone.llm.shared import new_folder

    kept, seen = new_folder(spark, "kept"), []
    for n, rows in enumerate([[(1, "x"), (2, "y"), (3, None)], [(4, "X"), (5, "z"), (6, "Z")], [(7, "y"), (0, "Z"), (8, "new"), (9, "")]]):
        path = str(tmp_path / f"table-{n}")
        spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(2).write.parquet(path)
        seen += rows
        got = sorted((r.id, r.keep, r.n) for r in exact_dedup.exact_groups(spark.read.parquet(path), kept=kept).collect())
        groups = defaultdict(list)
        for i, t in seen:
            groups[lowered(t)].append(i)
        assert got == sorted((i, max(groups[lowered(t)]), len(groups[lowered(t)])) for i, t in rows)
        alone = exact_dedup.exact_groups(spark.read.parquet(path)).collect()
        assert max(r.n for r in alone) == (2 if n == 1 else 1)


def test_exact_documents_that_stay(spark):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in ODD], SCHEMA)
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, lowered(r.text)[:9]) for r in out.collect()) == sorted((max((i or 0) for i, u in ODD if lowered(u) == k), k[:9]) for k in {lowered(t) for _, t in ODD})
    assert exact_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op9_near_dedup"](spark, sf_dir)) == expected(sf_dir, ORACLES["op9_near_dedup"])


def brute(rows, least_percent=85):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least_percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(seed, copies, words, edits):
    """Copies of one text, each with its own edits; similarities on both sides of the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_near_equals_brute_force(spark):
    texts = family(1, 120, 200, 6) + family(2, 40, 400, 14) + family(3, 30, 60, 2) + family(4, 25, 12, 1)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "one two three"), (906, "x " * 50_000), (907, "x " * 70_000), (None, texts[0]), (5, texts[5]), (None, "lonely words"), (908, "É two"), (909, "é two")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.id, r.n_shingles, r.component) for r in near_dedup.near_groups(df).collect()), key=str)
    assert got == brute(rows)


def test_near_squares_find_what_hubs_do_not(spark, monkeypatch):
    """With one hub round and blocks of seven members all links come from the squares."""
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "SQUARE", 7)
    rows = list(enumerate(family(5, 90, 150, 7)))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    assert sorted(((r.id, r.n_shingles, r.component) for r in near_dedup.near_groups(df).collect()), key=str) == brute(rows)


def test_near_documents_that_stay_and_empty_table(spark):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (4, None), (None, "a b c d e f"), (5, "z")]
    out = near_dedup.deduplicated(spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA))
    assert out.columns == ["doc_id", "text", "id", "n"] and {r.doc_id for r in out.collect()} == {2, 4, 5, None}
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_fill_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 2000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.concatenate([x[: max(1, n * 9 // 10)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        a, b = near_dedup.sketches([x, np.unique(y)])
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((a == b).mean() - j) < 0.13


def test_exact_state_is_met_again_and_sieves_keep_results(spark, monkeypatch):
    """Nothing is small enough to broadcast, so hits and dropped rows go through bitmaps; four triggers share state."""
    from siltstone.llm import shared

    rows = [(i % 90, f"Text {i % 40}", "clash", i) for i in range(400)] + [(None, "Text 3", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dedup_digest string, row int").repartition(8)
    seen, real = [], exact_dedup.stage
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "stage", lambda d, name, **how: seen.append(name) or real(d, name, **how))
    got = sorted(((r.id, r.keep, r.n) for r in exact_dedup.exact_groups(df).collect()), key=str)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lowered(t)].append(i)
    top = {k: max(i for i in v if i is not None) for k, v in groups.items()}
    assert got == sorted(((i, top[lowered(t)], len(groups[lowered(t)])) for i, t, *_ in rows), key=str) and "dedup-content" in seen
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id, lowered(r.text)) for r in out.collect()) == sorted((i, k) for k, i in top.items())
    assert {r._dedup_digest for r in out.collect()} == {"clash"}


def test_stream_has_several_triggers(spark):
    from siltstone.llm.shared import stage

    entries = stage(spark.range(0, 100, 1, 8).selectExpr("id", "cast(id % 10 as string) as digest", "'f' as file", "id as row"), "test-entries")
    state = exact_dedup.stream_state(entries).collect()
    assert {(r.digest, r.keep, r.row, r.n) for r in state} == {(str(d), 90 + d, 90 + d, 10) for d in range(10)}
    import glob

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    runs = glob.glob(f"{shared}/dedup-state-*/trigger=*")
    assert max(int(p.rsplit("=", 1)[1]) for p in runs) >= exact_dedup.TRIGGERS - 1


def test_matching_beyond_broadcasts(spark, monkeypatch):
    from siltstone.llm import shared

    df = spark.createDataFrame([(i, f"w{i}", i % 3, b"x") for i in range(300)] + [(None, "n", 1, b"x"), (None, None, 2, None)], "bit long, row string, bucket int, held binary")
    keys = shared.stage(spark.createDataFrame([(5, "w5"), (7, "other"), (None, "n"), (None, None), (250, "w250"), (250, "w250")], "a long, b string"), "test-keys")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    on = {"a": df["bit"], "b": df["row"]}
    found, rest = shared.matching(df, on, keys, "left_semi"), shared.matching(df, on, keys, "left_anti")
    assert sorted(((r.bit, r.row) for r in found.collect()), key=str) == sorted([(5, "w5"), (250, "w250"), (None, "n"), (None, None)], key=str)
    assert found.columns == rest.columns == df.columns and rest.count() == 298


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest
    from siltstone.llm import shared

    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
