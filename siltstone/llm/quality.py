"""Quality: random-indexing word vectors pooled per document, then a two-layer network.

Every token is a word (hashed into buckets) with a shape: its case, its end, digits, or that it repeats
the word before. Words and shapes have sparse ternary index vectors. Random indexing adds to each word
and shape the index vectors of its neighbours, over a bounded labelled sample; the sums are integers and
so the same in any order. A document's vector is the mean of its words' and shapes' context vectors and
of its shapes' index vectors. A two-layer numpy network classifies it; a temperature fitted on a part of
the sample that the network didn't see calibrates the probability. All documents are scored over whole
texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import blocks, fold, labelled_sample
from .shared import released, small_batches, stage, staged_texts

#: Buckets of words, shapes after them (the last is the gap between documents), width of the vectors.
WORDS, SHAPES, WIDTH = 1 << 13, 32, 32
GAP = WORDS + SHAPES - 1
REPEATED = SHAPES - 2

#: Labelled documents that fitting takes at most; words remembered by a task; characters at once.
SAMPLE, REMEMBERED, BLOCK = 16_000, 200_000, 1 << 20
HIDDEN, PASSES, BATCH, RATE = 24, 60, 128, 0.01

#: Fixed value: marks that end clauses.
CLAUSE_ENDS = frozenset(".,;:?!'\")")


def index_vectors(seed: int = 7) -> np.ndarray:
    """Ternary, four non-zero entries each; none for the gap."""
    rng = np.random.default_rng(seed)
    r = np.zeros((WORDS + SHAPES, WIDTH), dtype=np.int32)
    at = np.argsort(rng.random(r.shape), axis=1)[:, :4]
    np.put_along_axis(r, at, rng.choice(np.array([-1, 1], dtype=np.int32), at.shape), axis=1)
    r[GAP] = 0
    return r


class Tokens(dict):
    """A word as bucket * SHAPES + shape, remembered for the first words met."""

    def __missing__(self, word: str) -> int:
        last = word[-1]
        case = 0 if word.islower() else 3 if not any(map(str.isalpha, word)) else 2 if len(word) > 2 and word.isupper() else 1
        end = 0 if last.isalnum() else 1 if last in CLAUSE_ENDS and (len(word) < 2 or word[-2].isalnum()) else 2
        code = zlib.crc32(word.lower().encode()) % WORDS * SHAPES + case * 6 + end * 2 + any(map(str.isdigit, word))
        if len(self) < REMEMBERED:
            self[word] = code
        return code


def tokens(texts: list[str], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shapes (as rows of the vectors) of all texts end to end; the texts' lengths."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    code = np.fromiter((known[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
    word, shape = code // SHAPES, code % SHAPES + WORDS
    again = np.zeros(len(code), dtype=bool)
    again[1:] = code[1:] == code[:-1]
    starts = np.cumsum(sizes) - sizes
    again[starts[sizes > 0]] = False
    shape[again] = WORDS + REPEATED
    return word, shape, sizes


def contexts(texts: list[str], known: Tokens, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words and shapes met, their summed contexts and counts."""
    word, shape, sizes = tokens(texts, known)
    gaps = np.repeat(np.cumsum(sizes), 2)
    word, shape = np.insert(word, gaps, GAP), np.insert(shape, gaps, GAP)
    e = index[word] + index[shape]
    c = np.zeros_like(e)
    for gap, weight in ((1, 2), (2, 1)):
        c[gap:] += weight * e[:-gap]
        c[:-gap] += weight * e[gap:]
    rows = np.concatenate([word, shape])
    order = np.argsort(rows, kind="stable")
    at = np.flatnonzero(np.diff(rows[order], prepend=-1))
    return rows[order][at], np.add.reduceat(c[order % len(c)], at, axis=0), np.diff(np.append(at, len(order)))


def random_indexing(sample: DataFrame) -> np.ndarray:
    """The context vectors, of unit length around their mean. Their number is fixed, so they fit the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = index_vectors(), Tokens()
        total = np.zeros((WORDS + SHAPES, WIDTH + 1), dtype=np.int64)
        for batch in released(batches):
            texts = batch.column(0).to_pylist()
            for a, b in blocks([len(t) for t in texts], BLOCK // 4):
                rows, sums, counts = contexts(texts[a:b], known, index)
                total[rows, :WIDTH] += sums
                total[rows, WIDTH] += counts
        rows = np.flatnonzero(total[:, WIDTH])
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, d]) for d in range(WIDTH + 1))], names=["row", *(f"d{d}" for d in range(WIDTH + 1))])

    columns = [f"d{d}" for d in range(WIDTH + 1)]
    sums = sample.select("text").mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in columns))
    with small_batches(sample.sparkSession):
        found = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("row")
    out = np.zeros((WORDS + SHAPES, WIDTH))
    if len(found):
        at, c = found["row"].to_numpy(), found[columns].to_numpy(dtype=float)
        mean = c[:, :WIDTH].sum(axis=0) / max(c[:, WIDTH].sum(), 1)
        v = c[:, :WIDTH] / c[:, WIDTH:] - mean
        out[at] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(texts: list[str], known: Tokens, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row of 3 * WIDTH + 1 numbers per text: means of the vectors, and the log of the length."""
    word, shape, sizes = tokens(texts, known)
    out = np.zeros((len(texts), 3 * WIDTH + 1))
    doc = np.repeat(np.arange(len(texts)), sizes)
    for a in range(0, len(word), 1 << 16):  # a bounded piece at a time, also within a long text
        here = slice(a, a + (1 << 16))
        at = np.flatnonzero(np.diff(doc[here], prepend=-1))
        rows = doc[here][at]
        out[rows, :WIDTH] += np.add.reduceat(vectors[word[here]], at, axis=0)
    counts = np.bincount(doc * SHAPES + shape - WORDS, minlength=len(texts) * SHAPES).reshape(len(texts), SHAPES).astype(float)
    out[:, WIDTH : 2 * WIDTH] = counts @ vectors[WORDS:]
    out[:, 2 * WIDTH : -1] = counts @ index[WORDS:]
    out[:, :-1] /= np.maximum(sizes, 1)[:, None]
    out[:, -1] = np.log1p(sizes)
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on log loss over four fifths of the rows; the temperature is the best on the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    fitting, rest = order[len(x) // 5 :], order[: len(x) // 5]
    mean, scale = x[fitting].mean(axis=0), x[fitting].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rate = np.clip(y[fitting].mean(), 0.01, 0.99)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    passes = max(PASSES // 4, min(PASSES, PASSES * 4_000 // max(len(x), 1)))
    for k in range(passes):
        mixed = rng.permutation(fitting)
        for i in range(0, len(mixed), BATCH):
            at = mixed[i : i + BATCH]
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - RATE * (1 - k / passes) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    logits, truth = net.logit(x[rest]), y[rest]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t) if len(rest) else 0.0
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]), min((float(t) for t in np.geomspace(0.5, 4.0, 43)), key=loss))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network | None


def fit(sample: DataFrame) -> Model:
    """sample (id, text, label), bounded, to vectors and network. Without labels every score is 0.5."""
    sample = stage(sample, "quality-sample")
    vectors = random_indexing(sample)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = index_vectors(), Tokens()
        for batch in released(batches):
            texts = batch.column(2).to_pylist()
            for a, b in blocks([len(t) for t in texts], BLOCK):
                x = pooled(texts[a:b], known, vectors, index)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), pa.array(list(x), type=pa.list_(pa.float64()))], names=["id", "label", "x"])

    def learn(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("label", "ascending")])
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        net = train(x, table["label"].to_numpy().astype(float))
        return pa.table({"name": list(net.__dict__), "values": pa.array([np.ravel(v).tolist() for v in net.__dict__.values()])})

    rows = sample.select("id", "label", "text").mapInArrow(pool, f"id {sample.schema['id'].dataType.simpleString()}, label int, x array<double>")
    with small_batches(sample.sparkSession):
        found = {r["name"]: np.array(r["values"]) for r in rows.groupBy(F.lit("all")).applyInArrow(learn, "name string, values array<double>").collect()}  # the bounded sample's pooled rows
    if not found:
        return Model(vectors, None)
    return Model(vectors, Network(found["mean"], found["scale"], found["w1"].reshape(-1, HIDDEN), found["b1"], found["w2"], float(found["b2"][0]), float(found["temperature"][0])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher is better) of every row of docs. A null text is an empty one, and
    scores as the network does for a vector of zeros. Repeated rows score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = index_vectors(), Tokens()
        for batch in released(batches):
            texts = batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts], BLOCK):
                p = model.network.probability(pooled(texts[a:b], known, model.vectors, index)) if model.network else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, score double")


def learnt(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(labelled_sample(docs, labels, "quality", folds, held_out, sample, id_col, text_col))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score of every row of docs, learnt from the labels outside the held-out fold. Null and empty
    texts score as a vector of zeros; a null id is in the fold of an empty one; without docs there are no rows,
    without labels every score is 0.5. Repeated rows score alike; other columns may have any name."""
    model = learnt(docs, labels, folds, held_out, sample, id_col, text_col)
    return staged_texts(score(docs, model, id_col, text_col), "quality").select("id", (fold(F.col("id"), folds) == held_out).alias("held_out"), "score")
