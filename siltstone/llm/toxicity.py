"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of single words, neighbouring pairs and pairs with a word between, hashed
into 2^20 coordinates. The features of a bounded labelled sample are found in all tasks and learnt in
one, by FTRL-proximal with a rate per coordinate and an L1 threshold. L1 leaves few weights, whose number
the coordinates bound, so they travel with the scoring function. All documents are scored over their
whole texts. (Averaging learners over parts of the sample lost a tenth of the recall: words that are rare
in a part stay below the L1 threshold there.)
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import blocks, fold, labelled_sample
from .shared import released, small_batches, staged_texts

BITS = 20
WORDS = re.compile(r"\w+")

#: Labelled documents that fitting takes at most.
SAMPLE = 14_000

#: Words that a task remembers the hashes of; characters handled at once.
REMEMBERED, BLOCK = 200_000, 2 << 20


class Hashes(dict):
    """The hash of a word, remembered for the first words met."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode()) + 1
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def features(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every occurrence of a feature in the texts."""
    words = [WORDS.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = np.fromiter((hashes[w] for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - BITS)
    rows, found = [row], [(h * a) >> shift]
    for gap, salt in ((1, b), (2, c)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[gap:][same])
            found.append(((h[:-gap] * a ^ (h[gap:] + salt) * b) * c >> shift)[same])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.01
    passes: int = 6


@dataclass(frozen=True)
class Model:
    coordinates: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str], hashes: Hashes) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.coordinates] = self.weights
        rows, found = features(texts, hashes)
        used = dense[found] != 0
        pairs = np.unique(rows[used].astype(np.int64) << BITS | found[used])
        total = self.bias + np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _learn(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl, seed: int) -> tuple[np.ndarray, float]:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= how.l1, 0.0, -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))

    for _ in range(how.passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - labels[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= how.alpha / np.sqrt(bias_n) * g
    return weights(z, n), bias


def fit(sample: DataFrame, how: Ftrl = Ftrl()) -> Model:
    """sample (id, text, label), bounded, to a model. Without labels every score is 0.5."""

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in released(batches):
            for i, text in enumerate(batch.column(2).to_pylist()):
                x = np.unique(features([text], hashes)[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([x], type=pa.list_(pa.int32()))], names=["id", "label", "x"])

    def learn(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
        x = table["x"].combine_chunks()
        ends = x.offsets.to_numpy()
        w, bias = _learn(np.split(x.values.to_numpy(), ends[1:-1]), table["label"].to_numpy().astype(float), how, seed=11)
        kept = np.flatnonzero(w)
        return pa.table({"coordinate": pa.array(np.append(kept, -1), type=pa.int64()), "weight": pa.array(np.append(w[kept], bias))})

    rows = sample.select("id", "label", "text").mapInArrow(found_in, f"id {sample.schema['id'].dataType.simpleString()}, label int, x array<int>")
    with small_batches(sample.sparkSession):
        learnt = rows.groupBy(F.lit("all")).applyInArrow(learn, "coordinate long, weight double").collect()  # 2^20 rows at most; L1 leaves some hundreds
    weights = {r["coordinate"]: r["weight"] for r in learnt}
    bias = weights.pop(-1, 0.0)
    return Model(np.array(list(weights), dtype=np.int64), np.array(list(weights.values())), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row of docs; a null text is an empty one, whose score is that of
    the bias. Repeated rows score alike; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in released(batches):
            texts = batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts], BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(texts[a:b], hashes))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score of every row of docs, learnt from the labels outside the held-out fold. Null and empty
    texts score as the bias does; a null id is in the fold of an empty one; without docs there are no rows, without
    labels every score is 0.5. Repeated rows score alike; other columns may have any name."""
    model = fit(labelled_sample(docs, labels, "toxic", folds, held_out, sample, id_col, text_col))
    return staged_texts(score(docs, model, id_col, text_col), "toxicity").select("id", (fold(F.col("id"), folds) == held_out).alias("held_out"), "score")
