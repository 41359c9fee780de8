"""Exact similarity join of texts by T-occurrence search over inverted lists of their shingles.

A set of n shingles and a set that is linked with it share at least T of them, T following from the two sizes. The
join asks which sets occur on T or more of a set's inverted lists, without counting through the long ones (DivideSkip):
the lists are divided, the shortest are merged on a heap, which jumps over sets that can no longer reach T, and what
occurs on enough of them is looked up by bisection in the long ones until it has T or can't get there.

Before that the sets are dealt out so that linked ones meet in a task. Under any one order of all shingles the first
n - T' + l of a set of n, T' being the least that it shares with any partner, hold l that it has in common with each
partner; so a set that shares fewer than l of them with all others has none. With l = 1, any partner is in a bucket
with it, the sets that have one shingle among these. The order puts shingles last that are frequent by a table of counters of
fixed size, so a passage that many documents share brings few of them together; it is a matter of speed alone. Equal
sets are one class and take part once; buckets with the same members are one. Each bucket is first searched for one
member's partners, its hub's, then, if it is not within one component, for another one's; buckets that still hold
several components are searched completely, in squares of two blocks bounded in members and bytes, leaving out
partners of one's own component and those that are also in an earlier bucket together, so each pair is searched for
once. No link between different components is lost, nor does any bucket, list or number of
partners have a cap. Sets are compared by 64-bit hashes of their shingles; buckets are formed by shorter ones, which
may only bring more sets together.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import blocks
from .near_dedup import SIDES, SQUARE, SQUARE_BYTES, Limit, common, dealt, merged, mixed, runs, sets_of, shingle_sets
from .shared import checked_small, released, scratch, stage, staged_texts

#: Bytes of text at once; counters of shingles, as a power of two, and slices in which they travel.
BLOCK, CELL_BITS, SLICES = 2 << 20, 20, 64

#: Shingles in common that first ones must show, for each 100 of a set.
SHOWN = 20

#: Entries of first shingles that a task packs at once, and that one range of shingles should hold.
PACKED, RANGE_ENTRIES = 1 << 20, 4 << 20

#: Entries of first shingles whose classes, if all were shared, one slice of classes should hold.
SLICE_ENTRIES = 2 << 20

#: A shingle with more documents than this by its counter is sent row by row, so that no range is filled by one.
HOT = 1 << 20

#: Rounds with one hub a bucket; members of a block of a bucket that is searched completely.
HUB_ROUNDS, MEMBERS = 2, 1_000

#: The cost of a probe in a long list against a step of the merge, which settles how many lists are long.
MU = 0.0085

U = np.uint64


def least_common(n: int, m: int, least: int) -> int:
    """What sets of n and m shingles share at least if 100 * intersection >= least * union."""
    return -(-least * (n + m) // (100 + least))


class Lists:
    """Inverted lists of a block of sets. Sets are numbered by size, so the partners of a size are a range."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.token, self.start, self.row = token[first], np.append(first, len(token)), row

    def of(self, query: np.ndarray, allowed: np.ndarray) -> list[list[int]]:
        """The lists of the query's shingles, with the sets that are allowed."""
        at = np.searchsorted(self.token, query)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == query)]
        length = self.start[at + 1] - self.start[at]
        entry = np.arange(length.sum()) + np.repeat(self.start[at] - (np.cumsum(length) - length), length)
        row, number = self.row[entry], np.repeat(np.arange(len(at)), length)
        kept = allowed[row]
        row, number = row[kept].tolist(), number[kept]
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(row)]
        return [row[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(row, number of lists) of rows on at least `need` of the ascending lists, by a heap of their fronts. Where
    the least row is on too few lists, need - 1 lists in all jump to the least row of the others."""
    width = len(lists)
    if width < need:
        return
    heap = [rows[0] * width + i for i, rows in enumerate(lists)]
    heapq.heapify(heap)
    place = [0] * width
    while len(heap) >= need:
        row = heap[0] // width
        popped = []
        while heap and heap[0] // width == row:
            popped.append(heapq.heappop(heap) % width)
        if len(popped) >= need:
            yield row, len(popped)
            target = row + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap) % width)
            if not heap:
                return
            target = heap[0] // width
        for i in popped:
            rows = lists[i]
            at = place[i] + 1 if rows[place[i]] + 1 == target else bisect_left(rows, target, place[i])
            if at < len(rows):
                place[i] = at
                heapq.heappush(heap, rows[at] * width + i)


def partners(query: np.ndarray, index: Lists, least: int, allowed: np.ndarray) -> Iterator[int]:
    """The sets of the index, of those that are allowed, that are linked with the query."""
    n = len(query)
    low, high = bisect_left(index.sizes, -(-n * least // 100)), bisect_left(index.sizes, n * 100 // least + 1)
    allowed = allowed & (np.arange(len(allowed)) >= low) & (np.arange(len(allowed)) < high)
    if not allowed.any():
        return
    lists = index.of(query, allowed)
    need = least_common(n, index.sizes[int(allowed.argmax())], least)
    if len(lists) < need:
        return
    lists.sort(key=len)
    long = min(need - 1, int(need / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    for row, count in merge_skip(short, need - long):
        wanted = least_common(n, index.sizes[row], least)
        for left, rows in zip(range(len(probed), 0, -1), probed, strict=True):
            if count >= wanted or count + left < wanted:
                break
            at = bisect_left(rows, row)
            count += at < len(rows) and rows[at] == row
        if count >= wanted:
            yield row


def _sides(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a run: the rows of its two sides by size, which of them may be partners, and components as numbers. Partners
    differ in component and little enough in size, and have no earlier key than the run's in common."""
    side, size = t["side"].to_numpy(), t["n"].to_numpy()
    comp = t["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
    itself = not t["up"][0].as_py() and t["i"][0].as_py() == t["j"][0].as_py()
    order = np.argsort(size, kind="stable")
    left = order[side[order] == 0]
    right = left if itself else order[side[order] == 1]
    a, b = size[left][:, None], size[right][None, :]
    may = (comp[left][:, None] != comp[right][None, :]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * least)
    if itself:
        may = np.triu(may, 1)
    if may.any():
        key = t["key"][0].as_py()
        keys = [x.values.to_numpy() for x in t["keys"]]
        earlier = [x[x < key] for x in keys]
        if any(map(len, earlier)):
            may &= common([earlier[i] for i in left], [earlier[i] for i in right]) == 0
    return left, right, may, comp.tolist()


def hopeful(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of every run that may have a partner in it."""
    for t in runs(released(batches), SIDES):
        left, right, may, _ = _sides(t, least)
        kept = np.zeros(t.num_rows, dtype=bool)
        kept[left] |= may.any(axis=1)
        kept[right] |= may.any(axis=0)
        yield from t.filter(pa.array(kept)).combine_chunks().to_batches()


def searched(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join components, one each, of every run of rows with one name (SIDES): the sets of side 0
    search among those of side 1, or among themselves where the run has one block only."""
    for t in runs(released(batches), SIDES):
        left, right, may, comp = _sides(t, least)
        if not may.any():
            continue
        above = list(range(max(comp) + 1))

        def root(c: int, above: list[int] = above) -> int:
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        sets = [x.values.to_numpy() for x in t["set"]]
        index, out = Lists([sets[i] for i in right]), []
        for place, x in enumerate(left.tolist()):
            if not may[place].any():
                continue
            own = root(comp[x])
            roots = np.array([root(comp[y]) for y in right.tolist()])
            for row in partners(sets[x], index, least, may[place] & (roots != own)):
                y = int(right[row])
                if root(comp[y]) != root(comp[x]):
                    out.append((x, y))
                    above[root(comp[y])] = root(comp[x])
        if out:
            node, (a, b) = t["node"].combine_chunks(), zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])


def _narrow(counts: np.ndarray) -> np.ndarray:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(counts.max(initial=0)) <= np.iinfo(k).max)
    return counts.astype(kind)


def sized(docs: DataFrame, id_col: str, text_col: str, cell_bits: int = CELL_BITS) -> DataFrame:
    """id, n (size of the set) and node (its 128-bit hash, the class) of every row; and with n below 0 the slices
    (-n from 1) of each task's counters of shingles, with their bytes in `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, kind = np.zeros(1 << cell_bits, dtype=np.uint32), None
        for batch in released(batches):
            texts, kind = batch.column(1), batch.schema.field(0).type
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist())
                if sum(map(len, sets)):
                    at, more = np.unique(np.concatenate(sets) >> U(64 - cell_bits), return_counts=True)
                    cells[at.astype(np.int64)] += more.astype(np.uint32)
                n, node = pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, node, pa.nulls(b - a, pa.int32())], names=["id", "n", "node", "width"])
        if kind is not None and cells.any():
            parts = [_narrow(x) for x in np.split(cells, SLICES)]
            arrays = [pa.nulls(SLICES, kind), pa.array(range(-1, -SLICES - 1, -1), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x.itemsize for x in parts], pa.int32())], names=["id", "n", "node", "width"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, node binary, width int")


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw.as_py(), dtype=f"<u{w}").astype(np.uint64) for raw, w in zip(table["node"], table["width"].to_pylist(), strict=True))
    out = _narrow(total)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary()), pa.array([out.itemsize], pa.int32())], names=["n", "node", "width"])


def counters(rows: DataFrame) -> np.ndarray:
    """The sums of the tasks' counters, in two levels, so that none adds up more than the root of their number."""
    slices = rows.where("n < 0").select("n", "node", "width")
    tasks = max(1, slices.where("n = -1").count())
    some = slices.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(math.isqrt(tasks) + 1)))
    schema = "n long, node binary, width int"
    some = some.groupBy("n", "salt").applyInArrow(_summed, schema)
    found = stage(some.groupBy("n").applyInArrow(_summed, schema), "join-counters").orderBy(F.desc("n")).collect()  # SLICES rows
    return np.concatenate([np.frombuffer(r.node, dtype=f"<u{r.width}").astype(np.uint64) for r in found]) if found else np.zeros(2, dtype=np.uint64)


def shown(n: int, least: int) -> int:
    """How many of the first shingles of a set of n it has in common with a partner at least."""
    return max(1, min(SHOWN * n // 100, -(-n * least // 100)))


class Order:
    """The order of all shingles: frequent ones last."""

    def __init__(self, levels: bytes, least: int, hot: int) -> None:
        self.level, self.least = np.frombuffer(levels, dtype=np.uint8), least
        self.shift, self.bound = U(64 - (len(self.level).bit_length() - 1)), _level(np.array([hot]))[0]

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.level[(s >> self.shift).astype(np.int64)]

    def first(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The first shingles, and how many of them make buckets."""
        n = len(s)
        rank = self.of(s).astype(np.uint64) << U(56) | s >> U(8)
        left = n - -(-n * self.least // 100)
        return s[np.argsort(rank, kind="stable")[: left + shown(n, self.least)]], left + 1


def _firsts(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """Class, first shingles, how many of them make buckets and how many it must share with others to be linked with
    any, which its smallest partner says, of every text with words."""
    for batch in released(batches):
        texts = batch.column(0)
        for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK):
            for s in shingle_sets(texts.slice(a, b - a).to_pylist()):
                if len(s):
                    yield xxhash.xxh3_128_digest(s.tobytes()), *order.first(s), shown(-(-len(s) * order.least // 100), order.least)


def _ranged(batches: Iterator[pa.RecordBatch], ranges: int, hot: int, levels, least: int) -> Iterator[pa.RecordBatch]:
    """First shingles by ranges: part, tokens (32 bits of each), owner (twice the place of its class in nodes, plus 1 if
    it makes a bucket), nodes and needs (what each must share), many entries a row, without those that may be in more than `hot` documents. A class
    comes once among so many."""
    order = Order(levels.value, least, hot)
    held: dict[bytes, tuple[np.ndarray, int, int]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        nodes, token, needs = list(held), np.concatenate([x for x, _, _ in held.values()]), np.array([x for _, _, x in held.values()], dtype="<u4")
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x, _, _ in held.values()])
        makes = np.concatenate([np.arange(len(x)) < n for x, n, _ in held.values()])
        cool = order.of(token) <= order.bound
        token, owner, makes = token[cool], owner[cool], makes[cool]
        part = (token >> U(32)) % U(ranges)
        at = np.argsort(part, kind="stable")
        token, owner, makes, part = token[at].astype(np.uint32), owner[at], makes[at], part[at].astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=len(cuts) > 0):
            used, place = np.unique(owner[a:b], return_inverse=True)
            kind = "<u2" if len(used) <= 1 << 15 else "<u4"
            rows.append((int(part[a]), token[a:b].astype("<u4").tobytes(), (2 * place + makes[a:b]).astype(kind).tobytes(), b"".join(nodes[i] for i in used), needs[used].tobytes()))
        held.clear()
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "tokens", "owner", "nodes", "needs"])

    size = 0
    for node, first, n, need in _firsts(batches, order):
        size += 0 if node in held else len(first)
        held[node] = first, n, need
        if size > PACKED:
            yield from given()
            size = 0
    yield from given()


def _hot(batches: Iterator[pa.RecordBatch], hot: int, levels, least: int) -> Iterator[pa.RecordBatch]:
    """The first shingles that _ranged() leaves out, with their classes and what these must share; key is the shingle
    if it makes a bucket."""
    order = Order(levels.value, least, hot)
    for node, first, n, need in _firsts(batches, order):
        found = order.of(first) > order.bound
        token, makes = first[found].view(np.int64), np.flatnonzero(found) < n
        arrays = [pa.array(token, mask=~makes), pa.array([node] * len(token), pa.binary()), pa.array([need] * len(token), pa.int32()), pa.array(token)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "need", "token"])


#: Of a slice of classes, many a row: nodes with their needs and the number of shingles that each shares (tokens), and
#: buckets (keys) with their members.
SHARED = "slice int, nodes binary, needs binary, tokens binary, keys binary, members binary"


def _brief(names: np.ndarray) -> np.ndarray:
    return names.view("<u8").reshape(-1, 2)[:, 0]


def _named(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_py() for x in c), dtype="V16") for c in columns]


def _by_slice(slices: int, names: np.ndarray, needs: np.ndarray, tokens: np.ndarray, keys: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    """SHARED: every slice once. Members are among the names."""
    to, into = _brief(names) % U(slices), _brief(members) % U(slices)
    a, b = np.argsort(to, kind="stable"), np.argsort(into, kind="stable")
    found = np.unique(to)
    cuts, more = np.searchsorted(to[a], found), np.searchsorted(into[b], found)
    runs_ = list(zip(np.split(a, cuts[1:]), np.split(b, more[1:]), strict=True)) if len(found) else []
    columns = [[names[i].tobytes(), needs[i].astype("<u4").tobytes(), tokens[i].astype("<u4").tobytes(), keys[j].astype("<i8").tobytes(), members[j].tobytes()] for i, j in runs_]
    arrays = [pa.array(found.astype(np.int32)), *(pa.array([c[k] for c in columns], pa.binary()) for k in range(5))]
    return pa.RecordBatch.from_arrays(arrays, names=["slice", "nodes", "needs", "tokens", "keys", "members"])


def _packed(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """SHARED of the rows of _hot(), each a shingle that its class shares."""
    for batch in batches:
        if batch.num_rows:
            names, (key, need) = _named(batch["node"])[0], (batch["key"], batch["need"].to_numpy())
            makes = key.is_valid().to_numpy(zero_copy_only=False)
            yield _by_slice(slices, names, need, np.ones(len(names)), key.drop_null().to_numpy(), names[makes])


def _shared(key: tuple, table: pa.Table, slices: int) -> pa.Table:
    """Of a range the first shingles that several classes have (SHARED), those that make a bucket with a key, of
    buckets with the same classes one."""
    part, token, owner, base = key[0].as_py(), [], [], 0
    for raw, own, nodes in zip(table["tokens"], table["owner"], table["nodes"], strict=True):
        token.append(np.frombuffer(raw.as_py(), dtype="<u4"))
        kind = "<u2" if len(own.as_py()) == 2 * len(token[-1]) else "<u4"
        owner.append(np.frombuffer(own.as_py(), dtype=kind).astype(np.int64) + 2 * base)
        base += len(nodes.as_py()) // 16
    token, owner, names = np.concatenate(token), np.concatenate(owner), _named(table["nodes"])[0]
    needs = np.frombuffer(b"".join(x.as_py() for x in table["needs"]), dtype="<u4")
    brief = _brief(names)
    order = np.lexsort((brief[owner >> 1], token))
    token, node, makes = token[order], owner[order] >> 1, (owner[order] & 1).astype(bool)
    new = np.concatenate([[True], token[1:] != token[:-1]])
    once = new | np.concatenate([[True], brief[node[1:]] != brief[node[:-1]]])  # a class comes from many tasks
    token, node, makes, new = token[once], node[once], makes[once], new[once]
    several = np.repeat(_lengths(new) > 1, _lengths(new))
    token, node, makes = token[several], node[several], makes[several]
    _, first, tokens = np.unique(brief[node], return_index=True, return_counts=True)
    counts = node[first]

    token, node = token[makes], node[makes]
    new = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
    m = _lengths(new)
    prints = np.add.reduceat(_scattered(brief[node]), np.flatnonzero(new)) if len(token) else np.zeros(0, dtype=np.uint64)
    kept = np.zeros(len(m), dtype=bool)
    if len(m):
        kept[np.unique(np.stack([prints, m.astype(np.uint64)], axis=1), axis=0, return_index=True)[1]] = True
    rows = np.repeat(kept & (m > 1), m)
    return pa.Table.from_batches([_by_slice(slices, names[counts], needs[counts], tokens, token[rows].astype(np.int64) | part << 32, names[node[rows]])])


def _near(table: pa.Table) -> pa.Table:
    """Of a slice of classes the buckets, with key and node, of those that share enough with others. Classes of which
    the first halves of the names agree count as one here, which may only leave more in."""
    names, members = _named(table["nodes"], table["members"])
    needs, tokens, keys = (np.frombuffer(b"".join(x.as_py() for x in table[c]), dtype=kind) for c, kind in (("needs", "<u4"), ("tokens", "<u4"), ("keys", "<i8")))
    found, place = np.unique(_brief(names), return_inverse=True)
    least = np.full(len(found), np.iinfo(np.uint32).max, dtype=np.uint32)
    np.minimum.at(least, place, needs)
    enough = np.isin(_brief(members), found[np.bincount(place, weights=tokens, minlength=len(found)) >= least])
    return pa.table([pa.array(keys[enough]), pa.array([x.tobytes() for x in members[enough]], pa.binary())], names=["key", "node"])


def _lengths(new: np.ndarray) -> np.ndarray:
    """The lengths of the runs that begin where `new` is true."""
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _scattered(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U(29))) * U(0x9E3779B97F4A7C15)


def _level(counts: np.ndarray) -> np.ndarray:
    """Eighths of the binary logarithm."""
    return np.minimum(255, 8 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def buckets(docs: DataFrame, classes: DataFrame, counts: np.ndarray, text_col: str, least: int, hot: int = HOT) -> DataFrame:
    """key and node of the first shingles that several classes have, of the classes that share enough with others
    to be linked with any; of keys with the same classes one."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_level(counts).tobytes())
    entries = (classes.agg(F.sum("n")).first()[0] or 0) * (100 - least + SHOWN) // 100
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ENTRIES))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SLICE_ENTRIES))
    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sent = texts.mapInArrow(partial(_ranged, ranges=ranges, hot=hot, levels=levels, least=least), "part int, tokens binary, owner binary, nodes binary, needs binary")
    shares = sent.groupBy("part").applyInArrow(lambda key, table: _shared(key, table, slices), SHARED)
    if (_level(counts) > _level(np.array([hot]))[0]).any():
        alone = texts.mapInArrow(partial(_hot, hot=hot, levels=levels, least=least), "key long, node binary, need int, token long").distinct()
        shares = shares.unionByName(alone.mapInArrow(partial(_packed, slices=slices), SHARED))
    shares = staged_texts(shares, "join-shared")
    members = stage(shares.groupBy("slice").applyInArrow(_near, "key long, node binary"), "join-near")
    keys = members.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("print"), F.count(F.lit(1)).alias("m")).where("m > 1")
    keys = stage(keys.groupBy("print", "m").agg(F.min("key").alias("key")).select("key"), "join-keys")
    return stage(members.join(checked_small(keys), "key"), "join-members")


COLUMNS = [*SIDES, "side", "node", "comp", "n", "keys"]


def _links(rows: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The links within runs of rows (COLUMNS). Rows that may have a partner in their run get their sets."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key long, class int, up int, i int, j int, side int, node binary, comp binary, n long, keys array<bigint>"
    rows = rows.select(*COLUMNS).repartition(parts, *SIDES).sortWithinPartitions(*SIDES).mapInArrow(partial(hopeful, least=least), schema)
    rows = stage(rows, "join-runs")
    some = sets.join(checked_small(stage(rows.select("node").distinct(), "join-met")), "node", "left_semi")
    found = rows.join(some, "node").repartition(parts, *SIDES).sortWithinPartitions(*SIDES).select(*COLUMNS, "set")
    return staged_texts(found.mapInArrow(partial(searched, least=least), "a binary, b binary"), "join-links")


def stars(open_: DataFrame, classes: DataFrame, turn: int, least: int) -> DataFrame:
    """The runs in which the hub of each bucket (key, node, comp) meets its members of other components, each pair
    once whatever the number of their buckets, in blocks bounded in members and bytes."""
    hubs = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))).alias("x"))
    hubs = stage(hubs.select("key", "x.hub", "x.hub_comp"), "join-hubs")
    pairs = open_.join(checked_small(hubs), "key").where("comp != hub_comp").select("hub", "hub_comp", "node", "comp").distinct()
    pairs = pairs.join(checked_small(classes).select("node", "n"), "node")
    pairs = pairs.join(checked_small(classes).select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
    pairs = stage(pairs.where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * least), "join-pairs")
    many = F.greatest(F.ceil(F.count(F.lit(1)) / SQUARE), F.ceil(F.sum("n") * 8 / SQUARE_BYTES)).cast("int")
    sizes = stage(pairs.groupBy("hub", "hub_comp", "hub_n").agg(many.alias("blocks")), "join-stars")
    name = [F.xxhash64("hub").alias("key"), F.lit(0).alias("class"), F.lit(1).alias("up"), F.lit(0).alias("i")]
    left = sizes.select(*name, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub_comp").alias("comp"), F.col("hub_n").alias("n"))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    right = pairs.join(checked_small(sizes).select("hub", "blocks"), "hub").select(*name, block.alias("j"), F.lit(1).alias("side"), "node", "comp", "n")
    return left.unionByName(right).withColumn("keys", F.array().cast("array<bigint>"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 80) -> DataFrame:
    """A row per row of docs: id, n_shingles, component (least id that links reach). Links join sets of five-word
    shingles with 100 * intersection >= least * union, all of them.

    A null text is an empty one; an empty set is linked with nothing and its component is its own id. A text of fewer
    words than five is one shingle. Null ids are no least id; a component of null ids only has a null one. Repeated
    rows are in one class. Texts of any length are read whole. No rows give none; other columns are not read.
    """
    limit = Limit(least)
    with scratch():
        rows = staged_texts(sized(docs, id_col, text_col), "join-rows", keep=True)
        classes = stage(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n")), "join-classes")
        members = buckets(docs, classes, counters(rows), text_col, least)
        comp = stage(members.select("node").distinct().select("node", F.col("node").alias("comp")), "join-comp")
        some = stage(classes.join(checked_small(comp), "node", "left_semi").select("node", "least", "n"), "join-some")
        ids = stage(some.select(F.col("least").alias("id")).distinct(), "join-ids")
        sets = sets_of(docs, ids, id_col, text_col)
        met = rows.where("n > 0").join(checked_small(ids), rows["id"].eqNullSafe(ids["id"]), "left_semi")
        if not met.groupBy("id", "node").count().where("count > 1").isEmpty():  # repeated rows: of each set one is enough
            sets = sets.groupBy("node").agg(F.first("set").alias("set"))
        sets = staged_texts(sets, "join-sets")
        open_ = mixed(members, comp)
        for turn in range(HUB_ROUNDS):
            if open_.isEmpty():
                break
            comp = merged(comp, _links(stars(open_, some, turn, least), sets, least))
            open_ = mixed(open_.select("key", "node"), comp)
        if not open_.isEmpty():
            keys = stage(open_.groupBy("node").agg(F.collect_list("key").alias("keys")), "join-keys-of")  # of first shingles
            whole = open_.select("key", "node", "comp").join(checked_small(some).select("node", "n"), "node")
            comp = merged(comp, _links(dealt(whole, limit, MEMBERS).join(checked_small(keys), "node"), sets, least))
        by_node = classes.select("node", "least").join(comp, "node", "left")
        joined = stage(by_node.where("comp is not null").groupBy("comp").agg(F.min("least").alias("component")), "join-least")
        reached = stage(by_node.join(joined, "comp", "left").select("node", F.coalesce("component", "least").alias("component")), "join-reached", keep=True)
    full = rows.where("n > 0").join(reached, "node").select("id", "n", "component")
    return full.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component"))).withColumnRenamed("n", "n_shingles")
