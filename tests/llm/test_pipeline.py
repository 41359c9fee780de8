from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from siltstone.llm.queries import QUERIES
from siltstone.llm.shared import stage
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def mixed_by_hand(docs):
    """The rows that a mix of the documents holds: each source in the order of its tickets, pass after pass, up to its
    target; a document counts if at least half of it is taken."""
    from test_mixing import brute_targets

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = defaultdict(list)
    for r in docs:
        sources[r.source].append((md5(f"17:{'' if r.doc_id is None else r.doc_id}:{md5(r.text or '')}"), words(r.text), tuple(r)))
    sizes = {s: sum(n for _, n, _ in rows) for s, rows in sources.items()}
    out = Counter()
    for s, target in brute_targets(sizes).items():
        left = int(target + 0.5)
        for _, n, row in sorted(sources[s]) * 2:
            if n and 2 * min(n, left) >= n:
                out[row] += 1
            left = max(0, left - n)
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, work in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(work(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs.collect())
        assert name == "bpe" or docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    good = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    before, after = seen["exact_dedup"]
    top: dict = defaultdict(int)
    for r in before:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        top[key] = max(top[key], r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(top.values())
    from test_dedup import brute

    before, after = seen["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(d for d, n, c in brute([(r.doc_id, r.text) for r in before], 80) if not n or d == c)
    before, after = seen["mixing"]
    assert Counter(map(tuple, after)) == mixed_by_hand(before)
    before, after = seen["bpe"]
    want = Counter()
    for r in before:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, after)) == want


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text", "en", None, 5), (3, "w " * 50_000, "en", "s", None), (4, "a b c", None, "s", 1), (4, "a b c", None, "s", 1), (5, "A b c", "x", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        for _, work in corpus_pipeline.STAGES:
            assert work(spark, start, "/root/testdata/sf0.001").count() >= 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(names)


def test_run_leaves_only_what_is_read(spark):
    """Folders of the shared directory that run() leaves: the documents of the stages before BPE, and what the result reads."""
    import glob

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/*"))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{shared}/*")) - before}
    assert rows and left <= {*(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES), "bpe"}
