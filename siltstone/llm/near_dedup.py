"""MinHash near-deduplication by fast similarity sketching, banding and exact verification.

A sketch has a number of slots, its coordinates. Round after round every shingle is hashed into one
coordinate with a value that grows with the round, and each coordinate keeps its least value; rounds slots
to 2 * slots - 1 put all shingles into coordinate 0, 1, ... in turn, so every coordinate is filled, while a
large set is done after two or three rounds. The share of equal coordinates is concentrated around the
Jaccard similarity at least as well as with independent minimum hashes.

Documents with one shingle set are a class and take part once. Classes that agree on a whole band share a
bucket. In each bucket all members are first checked against one hub, then, for buckets whose members are
not in one component yet, against further hubs: so a large group of near copies costs a few checks a
member. Buckets that still hold several components are compared completely, leaving out pairs within a
component: members are sorted into classes by size, a step of the limit wide, as sets of further apart sizes
can't be linked; each class is dealt into blocks bounded in members and in bytes, and blocks of one class or of
neighbouring ones meet in squares. Every link is confirmed on the full shingle sets.

The limit of similarity is a parameter. Bands and the estimate that a compared pair needs follow from it: a
pair at the limit shares no bucket with probability 5e-7 at most, and the estimate is 4.8 standard deviations
below the limit, which a pair at the limit misses with some 4e-6. At 0.85 that is 25 bands of 5 and 87 of 125
coordinates, at 0.80 37 bands and 121 of 185.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import blocks
from .shared import checked_small, matching, released, scratch, stage, staged_texts

ROWS = 5
SHINGLE = 5

#: At the limit: the largest probability to share no bucket; standard deviations of the estimate below it.
MISS, DEVIATIONS = 5e-7, 4.8


@dataclass(frozen=True, slots=True)
class Limit:
    """Links have 100 * intersection >= least * union, least from 1 to 100. What follows from it: the bands,
    the coordinates of a sketch, and on how many of them compared pairs agree at least."""

    least: int

    def __post_init__(self) -> None:
        if not 1 <= self.least <= 100:
            raise ValueError(f"a limit of {self.least} is not between 1 and 100")

    @property
    def bands(self) -> int:
        return 1 if self.least == 100 else math.ceil(math.log(MISS) / math.log1p(-((self.least / 100) ** ROWS)))

    @property
    def slots(self) -> int:
        return self.bands * ROWS

    @property
    def agree(self) -> int:
        p = self.least / 100
        return max(0, int(self.slots * p - DEVIATIONS * math.sqrt(self.slots * p * (1 - p))))


DEFAULT = Limit(85)

#: Rounds with one hub a bucket; members of a block of a compared bucket, and bytes of their sets; bytes of text at once.
HUB_ROUNDS, SQUARE, SQUARE_BYTES, BLOCK = 2, 200, 4 << 20, 2 << 20

U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) << U(1) | U(1)


PLACES = _odd(SHINGLE + 1, 41)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: words of the text with A-Z lower-cased,
    five at a time; all of them if there are fewer; none if there is no word."""
    words = [t.encode().lower().split() for t in texts]  # on bytes, lower() and split() know ASCII only
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    first, total = np.cumsum(sizes) - sizes, int(counts.sum())
    ends = np.cumsum(counts)
    start = np.arange(total) + np.repeat(first - (ends - counts), counts)
    stop = np.repeat(first + sizes, counts)
    s = np.repeat(np.minimum(sizes, SHINGLE).astype(np.uint64) * PLACES[SHINGLE], counts)
    for j in range(SHINGLE):
        at = start + j
        inside = at < stop
        s += np.where(inside, h[np.where(inside, at, 0)] * PLACES[j], U(0)) if len(h) else U(0)
    s = _mixed(s)
    return [np.unique(x) for x in np.split(s, ends[:-1])] if len(texts) else []


def sketches(sets: list[np.ndarray], slots: int = DEFAULT.slots) -> np.ndarray:
    """A row of `slots` 16-bit coordinates for each set; zeros for an empty one."""
    keys = _odd(2 * slots, 43)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    x = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    empty = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * slots, empty)
    for r in range(2 * slots):
        if not len(x):
            break
        v = _mixed(x * keys[r] + U(r))
        slot = ((v >> U(40)) * U(slots) >> U(24)).astype(np.int64) if r < slots else r - slots
        np.minimum.at(out, row * slots + slot, U(r) << U(40) | v & U((1 << 40) - 1))
        open_ = (out.reshape(-1, slots) == empty).any(axis=1)[row]
        if not open_.all():
            x, row = x[open_], row[open_]
    coordinates = _mixed(out).astype(np.uint16).reshape(-1, slots)
    coordinates[sizes == 0] = 0
    return coordinates


def sketched(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """id, n (size of the set), node (128-bit hash of the set: the class) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = batch.column(1)
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist())
                rows = sketches(sets, slots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()), pa.array([r.tobytes() for r in rows], type=pa.binary())],
                    names=["id", "n", "node", "sketch"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, node binary, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and set (array of hashes) of the documents whose id is in ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = batch.column(0)
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()), pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64()))], names=["node", "set"])

    texts = _texts(docs, id_col, text_col)
    chosen = matching(texts, {"id": texts["id"]}, ids, "left_semi")
    return chosen.select("text").mapInArrow(run, "node binary, set array<bigint>")


def _agree(a: str, b: str, limit: Limit):
    """Whether two sketches agree on enough coordinates."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(limit.slots - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * 2 + 1, 2) == F.substring(b, i * 2 + 1, 2)).cast("int"))
    return same >= limit.agree


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are links: first by size and sketch, then on the full sets.
    A pair may come twice. No grouping follows the joins, so their hot keys can be split."""
    for side in ("a", "b"):
        pairs = pairs.join(checked_small(classes).select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    close = pairs.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * limit.least) & _agree("s_a", "s_b", limit)).select("a", "b", "n_a", "n_b")
    close = stage(close, "near-close")
    for side in ("a", "b"):
        close = close.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return stage(close.where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * limit.least).select("a", "b"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of all nodes of the edges (a, b), by least labels of
    neighbours and of one's own label, until nothing changes."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "near-labels")
    while True:
        heard = both.join(checked_small(labels).select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = stage(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "near-nearer")
        jump = checked_small(nearer).select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stage(nearer.join(jump, "label").select("node", F.col("next").alias("label"), "old"), "near-labels")
        labels = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return labels


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after the links join components."""
    if links.isEmpty():
        return comp
    for side in ("a", "b"):
        links = links.join(checked_small(comp).select(F.col("node").alias(side), F.col("comp").alias(f"c_{side}")), side)
    edges = stage(links.where("c_a != c_b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct(), "near-joins")
    if edges.isEmpty():
        return comp
    label = checked_small(components(edges)).select(F.col("node").alias("comp"), "label")
    return stage(comp.join(label, "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")), "near-comp")


def mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The members (key, band, node) of buckets that hold several components, with comp and m, their number."""
    now = stage(members.join(checked_small(comp), "node"), "near-now")
    keys = stage(now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 != c1").select("key", "m"), "near-keys")
    return stage(now.join(checked_small(keys), "key"), "near-mixed")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now])) + 1).tolist()
        if held and any(held[-1][k][-1].as_py() != c[0] for k, c in zip(keys, now, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            held.append(batch.slice(x, y - x))
            if y < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


#: What names a square: the bucket, the class of its left block, whether the right one is of the next class, and the blocks.
SIDES = ("key", "class", "up", "i", "j")


def _sides(t: pa.Table, limit: Limit) -> tuple[np.ndarray, ...]:
    """Of a square: the rows of its two blocks, sizes of the sets, components as numbers, and which rows may pair."""
    itself = not t["up"][0].as_py() and t["i"][0].as_py() == t["j"][0].as_py()
    side, size = t["side"].to_numpy(), t["n"].to_numpy()
    comp = t["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
    left = np.flatnonzero(side == 0)
    right = left if itself else np.flatnonzero(side == 1)
    a, b = size[left][:, None], size[right][None, :]
    may = (comp[left][:, None] != comp[right][None, :]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * limit.least)
    return left, right, size, comp, may & (left[:, None] < right[None, :]) if itself else may


def hopeful(batches: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """The rows of each square that agree on enough coordinates with a row of another component in the
    other block, in a bucket of the first band that the two share."""
    for t in runs(released(batches), SIDES):
        left, right, _, _, may = _sides(t, limit)
        if may.any():
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, limit.slots)
            band, keep = t["band"][0].as_py(), np.zeros(t.num_rows, dtype=bool)
            for x in np.flatnonzero(may.any(axis=1)):
                others = right[may[x]]
                same = sketch[others] == sketch[left[x]]
                good = others[(same.sum(axis=1) >= limit.agree) & (same.reshape(-1, limit.bands, ROWS).all(axis=2).argmax(axis=1) == band)]
                keep[good] = True
                keep[left[x]] |= len(good) > 0
            yield from t.drop_columns(["sketch", "band"]).filter(pa.array(keep)).combine_chunks().to_batches()


def common(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, as products of 0/1 matrices of up to `cells` entries."""
    width = max(64, cells // (len(left) + len(right)))
    sizes = np.fromiter(map(len, left + right), dtype=np.int64, count=len(left) + len(right))
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)))
    for a in range(0, len(values), width):
        x, y = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(sizes), min(width, len(values) - a)), dtype=np.float32)
        m[row[x:y], column[x:y] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def linked(batches: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components in each square, by the full sets; of links that join the same
    components, one each."""
    for t in runs(released(batches), SIDES):
        left, right, size, comp, may = _sides(t, limit)
        if not may.any():
            continue
        sets = [x.values.to_numpy() for x in t["set"]]
        both = common([sets[x] for x in left], [sets[x] for x in right])
        x, y = np.nonzero(may & (both * 100 >= (size[left][:, None] + size[right][None, :] - both) * limit.least))
        x, y = left[x], right[y]
        pair = np.minimum(comp[x], comp[y]).astype(np.int64) * t.num_rows + np.maximum(comp[x], comp[y])
        one = np.unique(pair, return_index=True)[1]
        node = t["node"].combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(x[one])), node.take(pa.array(y[one]))], names=["a", "b"])


def size_class(n: Column, limit: Limit) -> Column:
    """Sets whose classes differ by more than one are too unlike in size to be linked."""
    if limit.least == 100:
        return n.cast("int") * 2  # only equal sizes meet
    return F.floor(F.log(n.cast("double")) / (-math.log(limit.least / 100) * (1 + 1e-9))).cast("int")


def dealt(rows: DataFrame, limit: Limit, square: int | None = None) -> DataFrame:
    """The rows (key, node, n and others) of compared buckets, once for each square that they take part in, with its
    name (SIDES) and their side of it. A block holds some `square` members."""
    rows = stage(rows.withColumn("class", size_class(F.col("n"), limit)), "near-open")
    most = F.greatest(F.ceil(F.count(F.lit(1)) / (square or SQUARE)), F.ceil(F.sum("n") * 8 / SQUARE_BYTES)).cast("int")
    counts = stage(rows.groupBy("key", "class").agg(most.alias("blocks"), F.count(F.lit(1)).alias("members")), "near-blocks")
    near = counts.select("key", "class", "blocks", "members")
    for name, shift in (("up", -1), ("down", 1)):
        near = near.join(checked_small(counts).select("key", (F.col("class") + shift).alias("class"), F.col("blocks").alias(f"blocks_{name}")), ["key", "class"], "left")
    rows = rows.join(checked_small(stage(near, "near-classes-met")), ["key", "class"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int"))
    row = lambda c, up, i, j, side: F.struct(c.alias("class"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own, c = F.col("own"), F.col("class")
    same = F.transform(numbers(F.when(F.col("members") > 1, F.col("blocks")).otherwise(0)), lambda j: row(c, 0, F.least(own, j), F.greatest(own, j), own > j))
    up = F.transform(numbers(F.coalesce("blocks_up", F.lit(0))), lambda j: row(c, 1, own, j, F.lit(0)))
    down = F.transform(numbers(F.coalesce("blocks_down", F.lit(0))), lambda i: row(c - 1, 1, i, own, F.lit(1)))
    out = rows.withColumn("square", F.explode(F.concat(same, up, down)))
    return out.drop("class", "blocks", "members", "blocks_up", "blocks_down", "own").select("*", "square.*").drop("square")


def squares(open_: DataFrame, classes: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """The links (a, b) between different components within a bucket. In each square first the sketches leave the
    members that may have a partner there; then these are compared with their full sets."""
    rows = open_.select("key", "band", "node", "comp").join(checked_small(classes).select("node", "n", "sketch"), "node")
    rows = dealt(rows, limit).select(*SIDES, "side", "node", "comp", "n", "sketch", "band")
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = "key long, class int, up int, i int, j int, side int, node binary, comp binary, n long"
    some = stage(rows.repartition(parts, *SIDES).sortWithinPartitions(*SIDES).mapInArrow(partial(hopeful, limit=limit), kept), "near-hopeful")
    full = some.join(sets, "node").select(*some.columns, "set")
    return staged_texts(full.repartition(parts, *SIDES).sortWithinPartitions(*SIDES).mapInArrow(partial(linked, limit=limit), "a binary, b binary"), "near-links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = DEFAULT.least) -> DataFrame:
    """A row per row of docs: id, n_shingles, component (least id that links reach). Links join sets whose
    similarity is least / 100 or more.

    A null text is an empty one; an empty set is linked with nothing and its component is its own id. Null
    ids are no least id; a component of null ids only has a null one. Repeated rows are in one class. No rows
    give none; other columns are not read.
    """
    limit = Limit(least)
    return _grouped(docs, sketched(docs, id_col, text_col, limit.slots), id_col, text_col, limit)


def _grouped(docs: DataFrame, sketched_rows: DataFrame, id_col: str, text_col: str, limit: Limit) -> DataFrame:
    """near_groups() from the sketched rows of docs, whose further columns are kept."""
    more = [c for c in sketched_rows.columns if c not in ("id", "n", "node", "sketch")]
    rows = staged_texts(sketched_rows, "near-rows")
    full = rows.where("n > 0")
    with scratch():
        classes = stage(full.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")
        bands = F.transform(F.sequence(F.lit(0), F.lit(limit.bands - 1)), lambda j: F.struct(j.alias("band"), F.xxhash64(j, F.substring("sketch", j * 2 * ROWS + 1, 2 * ROWS)).alias("key")))
        keyed = classes.select("node", F.explode(bands).alias("x")).select("node", "x.band", "x.key")
        shared = stage(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "near-shared")
        members = stage(keyed.join(checked_small(shared), "key"), "near-members")
        comp = stage(members.select("node").distinct().select("node", F.col("node").alias("comp")), "near-comp")
        some = stage(classes.join(checked_small(comp), "node", "left_semi"), "near-some")
        sets = staged_texts(sets_of(docs, stage(some.select(F.col("least").alias("id")).distinct(), "near-ids"), id_col, text_col), "near-sets")

        pairs = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        comp = merged(comp, confirmed(pairs.distinct(), some, sets, limit))
        open_ = mixed(members.select("key", "band", "node"), comp)
        for turn in range(1, HUB_ROUNDS):
            if open_.isEmpty():
                break
            hubs = stage(open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))).alias("x")).select("key", "x.hub", "x.hub_comp"), "near-hubs")
            pairs = open_.join(checked_small(hubs), "key").where("comp != hub_comp").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            comp = merged(comp, confirmed(pairs.distinct(), some, sets, limit))
            open_ = mixed(open_.select("key", "band", "node"), comp)
        if not open_.isEmpty():
            comp = merged(comp, squares(open_, some, sets, limit))

        by_node = classes.select("node", "least").join(comp, "node", "left")
        joined = stage(by_node.where("comp is not null").groupBy("comp").agg(F.min("least").alias("component")), "near-least")
        reached = stage(by_node.join(joined, "comp", "left").select("node", F.coalesce("component", "least").alias("component")), "near-reached", keep=True)
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component"), *more)
    return full.join(reached, "node").select("id", "n", "component", *more).unionByName(alone).withColumnRenamed("n", "n_shingles")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = DEFAULT.least) -> DataFrame:
    """One document of each group, that with the least id, with the columns of docs. Documents without words
    and those with null ids stay; rows that repeat the id that stays, stay with it. A row goes by its id and
    text: other texts under its id are judged by their own groups."""
    limit, digest = Limit(least), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    keyed = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("row"), docs[text_col].alias("text"))
    rows = sketched(keyed, "row", "text", limit.slots).select("id.id", "id.digest", "n", "node", "sketch")
    with scratch():
        groups = _grouped(docs, rows, id_col, text_col, limit)
        gone = stage(groups.where("id is not null and component is not null and id != component").select("id", "digest").distinct(), "near-gone", keep=True)
    return matching(docs, {"id": docs[id_col], "digest": digest}, gone, "left_anti")
