from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import fill_in_middle as fim
from siltstone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, id string, n int, output string"


def plain(doc_id, text):
    """The same by regular expression and slices of a list."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), output


def test_equals_sql(spark, sf_dir):
    from oracle import expected, rows

    assert rows(QUERIES["op13_fill_in_middle"](spark, sf_dir)) == expected(sf_dir, ORACLES["op13_fill_in_middle"])


def test_cuts_in_blocks_of_any_size():
    rng = random.Random(5)
    for size in (1, 2, 3, 7, 64):
        for _ in range(60):
            text = "".join(rng.choice(["a", "Z", "é", "\U0001f600", " ", "\n", "ª", "ſ"]) for _ in range(rng.randrange(0, 90)))
            ends = [0]
            for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
                ends.append(ends[-1] + len(unit))
            blocks = fim.Blocks(text, size)
            assert blocks.total == len(ends) - 1
            assert [blocks.end_of(k) for k in range(len(ends) + 1)] == [*ends, len(text)]


def test_odd_rows(spark):
    texts = [None, "", "a", "é", "has <P> in it", "ends in <", "<S", "x<M", "<" * 50, "word " * 40_000, "q" * 100_000, "\U0001f600" * 9000, "tab\tand\r\nlines", "<P", "P>", "same", "same"]
    data = [(i // 2 if i % 5 else None, t, "clash", 0, "clash") for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = fim.fill_in_middle(df).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((plain(d[0], d[1]) for d in data), key=str)
    assert sorted(r.again for r in out) == sorted(d[1] or "" for d in data)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_a_parameter(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "", 0, "") for i in range(200)], SCHEMA)
    assert {r.form for r in fim.fill_in_middle(df, fim.Plan(cut=100, suffix_first=100)).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(df, fim.Plan(cut=0)).collect()} == {"plain"}
