"""Exact top-k search by inner product as a Voronoi k-nearest-neighbour join.

Pivots drawn from the data cut the space into cells; data and queries both go to the cell of their nearest
pivot. Two summaries are taken. Of the queries: a row per cell, with its number and radius. Of the data: a row
per cell and ring (a range of distances to the pivot), with number, least and largest distance and largest
length; and for each query cell the k + 1 best lower bounds of distinct identifiers, merged from all tasks.
From these follow, on the driver, a score that the k-th hit of every query in a cell reaches, and which rings
of which data cells may hold a better one. Query cells are put into groups, as many as ship the fewest rows by
the summaries: one group where bounds prune nothing, many where the vectors are clustered.

Only vectors in such rings that also pass the bound themselves are sent to a group. A group is solved on a grid:
its queries are dealt into blocks, its data into chunks, and every block meets every chunk in one task of
bounded size. So a vector is sent once per group that needs it and block of its queries, a query once per
chunk. Chunks return k hits a query, which are merged.

Of equal vectors only the k + 1 with the smallest identifiers can be among anyone's hits, so larger groups of
copies shrink to these before anything else, in the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stage

#: Pivots at most and rows of data for each (their vectors and summaries are held by the driver); rings of a cell.
PIVOTS, ROWS_PER_PIVOT, RINGS = 512, 256, 4

#: Queries and vectors of a task, and the bytes that its vectors may have as 64-bit numbers.
QUERY_BLOCK, DATA_BLOCK, BLOCK_BYTES = 4_096, 16_384, 16 << 20

#: Vectors that are multiplied with all pivots at once; queries scored at once.
SLICE, TILE = 2_048, 64

#: Products of 64-bit floats are exact below it; larger scores than a long holds count as its largest value.
EXACT, LONG = 1 << 53, (1 << 63) - 1

Array = np.ndarray


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, at most what a long holds; null for a null vector or one with null or
    non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), v * scale))).cast("long"))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> Array:
    """Vectors as rows, shorter ones padded with zeros, which add nothing to a product."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def in_cells(rows: DataFrame, pivots: Array) -> DataFrame:
    """rows (id, v) with their cell and the distance to its pivot."""
    width = pivots.shape[1]
    half = (pivots * pivots).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch.column(1), width)
            cell = np.argmin(half - 2 * (x @ pivots.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(x - pivots[cell], axis=1)), pa.array(np.linalg.norm(x, axis=1))], names=["id", "v", "cell", "r", "length"])

    return rows.select("id", "v").mapInArrow(assign, "id long, v array<bigint>, cell int, r double, length double")


@dataclass(frozen=True)
class Plan:
    """What the summaries say. By query cell: pivot, radius (with the rounding of sums), the score that k hits
    reach, group, and the rings of data cells that may hold a better one. By group: blocks and chunks."""

    centres: Array
    radius: Array
    floor: Array
    group: Array
    reach: Array
    blocks: Array
    chunks: Array
    cells: Array

    def sent(self, data: DataFrame) -> DataFrame:
        """data (id, v, cell, ring) as often as it is sent: id, v, group, block, chunk."""
        width, order = self.centres.shape[1], np.argsort(self.group, kind="stable")
        centres, radius, floor, reach = (a[order] for a in (self.centres, self.radius, self.floor, self.reach))
        first = np.searchsorted(self.group[order], np.arange(len(self.blocks)))
        blocks, chunks = self.blocks, self.chunks

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                x, at = _matrix(batch.column(1), width), batch.column(2).to_numpy() * RINGS + batch.column(3).to_numpy()
                may = reach[:, at]
                some = np.flatnonzero(may.any(axis=1))  # query cells that no ring of this slice can serve cost nothing
                high = centres[some] @ x.T + radius[some, None] * np.linalg.norm(x, axis=1)
                may[some] &= high >= floor[some, None]
                group, row = np.nonzero(np.logical_or.reduceat(may, first, axis=0))
                times = blocks[group]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, group = np.repeat(row, times), np.repeat(group, times)
                for a in range(0, len(row), DATA_BLOCK):
                    here = slice(a, a + DATA_BLOCK)
                    part = batch.take(pa.array(row[here]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(group[here].astype(np.int32)), pa.array(block[here].astype(np.int32)), pa.array(chunks[group[here]].astype(np.int32))], names=["id", "v", "group", "block", "chunks"])

        out = data.select("id", "v", "cell", "ring").mapInArrow(send, "id long, v array<bigint>, group int, block int, chunks int")
        return out.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), "chunks").cast("int")).drop("chunks")

    def asked(self, queries: DataFrame) -> DataFrame:
        """queries (id, v, cell) as often as they are sent: id, v, group, block, chunk."""
        of = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), F.col("group") + 1)
        cell_group = F.create_map(*(F.lit(int(x)) for pair in zip(self.cells, self.group, strict=True) for x in pair))
        rows = queries.select("id", "v", F.element_at(cell_group, F.col("cell")).alias("group"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(23)), of(self.blocks)).cast("int"))
        return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), (of(self.chunks) - 1).cast("int"))))


def _upper(centres: Array, radius: Array, longest: Array, pivots: Array, rings: list[Row]) -> Array:
    """By query cell and ring of a data cell: no product of two of their vectors is above this."""
    p = pivots[[r["cell"] for r in rings]]
    near, far, length = (np.array([r[c] for r in rings]) for c in ("near", "far", "length"))
    product, u = centres @ p.T, radius[:, None]
    apart = np.sqrt(np.maximum((centres * centres).sum(axis=1)[:, None] - 2 * product + (p * p).sum(axis=1), 0))
    around = product + np.linalg.norm(centres, axis=1)[:, None] * far
    gap = np.maximum(0, np.maximum(apart - u - far, near - apart - u))
    bounds = [around + u * length, around + u * (np.linalg.norm(p, axis=1) + far), (longest[:, None] ** 2 + length**2 - gap**2) / 2, longest[:, None] * length]
    return np.minimum.reduce(bounds)


def _groups(centres: Array, queries: Array, reach: Array, rows: Array, query_block: int, data_block: int) -> tuple[Array, Array, Array]:
    """The group of each query cell, and blocks and chunks of each group: of 1, 2, 4, ... groups around cells
    that are far from each other the number that ships the fewest rows."""
    n = len(centres)
    seeds, gap = [0], np.linalg.norm(centres - centres[0], axis=1)
    nearest, best = np.zeros(n, dtype=np.int64), None
    size = 1
    while True:
        group = np.unique(nearest, return_inverse=True)[1]
        many = group.max() + 1
        asked = np.bincount(group, weights=queries, minlength=many)
        needed = np.array([reach[group == g].any(axis=0) @ rows for g in range(many)])
        blocks, chunks = (np.maximum(1, -(-a // b)).astype(np.int64) for a, b in ((asked, query_block), (needed, data_block)))
        cost = blocks @ needed + asked @ chunks
        if best is None or cost < best[0]:
            best = (cost, group, blocks, chunks)
        if size >= n:
            return best[1:]
        size = min(2 * size, n)
        while len(seeds) < size:
            seeds.append(int(np.argmax(gap)))
            away = np.linalg.norm(centres - centres[seeds[-1]], axis=1)
            nearest[away < gap] = len(seeds) - 1
            nearest[seeds[-1]] = len(seeds) - 1
            gap = np.minimum(gap, away)


def planned(data: DataFrame, queries: DataFrame, pivots: Array, k: int) -> Plan:
    """The plan for data (id, v, cell, ring, r, length) and queries (id, v, cell, r, length), both staged and in
    cells."""
    held = sorted(queries.groupBy("cell").agg(F.max("r").alias("r"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["cell"])  # a row per pivot
    rings = data.groupBy("cell", "ring").agg(F.min("r").alias("near"), F.max("r").alias("far"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n")).collect()  # RINGS rows per pivot
    cells = np.array([r["cell"] for r in held])
    centres, longest = pivots[cells], np.array([r["length"] for r in held])
    slack = 1e-10 * longest * max(r["length"] for r in rings) + 1e-3  # more than float sums of products lose
    radius = np.array([r["r"] for r in held]) * (1 + 1e-10) + 1e-6

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(cells), 0), -np.inf)
        for batch in _slices(batches):
            x = _matrix(batch.column(0), pivots.shape[1])
            low = centres @ x.T - radius[:, None] * np.linalg.norm(x, axis=1)
            best = -np.sort(-np.concatenate([best, low], axis=1), axis=1)[:, : k + 1]
        where, _ = np.indices(best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(where.ravel()), pa.array(best.ravel())], names=["cell", "low"])

    # k + 1 rows of different ids: whichever id a query has, k of them are other rows.
    single = data if data.select("id").distinct().count() == data.count() else data.dropDuplicates(["id"])
    place = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("low")))
    low = single.select("v").mapInArrow(bounds, "cell long, low double").withColumn("n", place)
    reached = {r["cell"]: r["low"] for r in low.where(F.col("n") == k + 1).select("cell", "low").collect()}  # a row per pivot
    floor = np.array([reached.get(i, -np.inf) for i in range(len(cells))]) - slack
    floor = np.where(floor < -9.2e18, -np.inf, np.minimum(floor, 9.2e18))  # beyond a long, scores tie

    reach = np.zeros((len(cells), len(pivots) * RINGS), dtype=bool)
    at = np.array([r["cell"] * RINGS + r["ring"] for r in rings])
    reach[:, at] = _upper(centres, radius, longest, pivots, rings) + slack[:, None] >= floor[:, None]
    rows = np.zeros(reach.shape[1])
    rows[at] = [r["n"] for r in rings]
    fit = max(64, BLOCK_BYTES // (8 * max(1, pivots.shape[1])))
    group, blocks, chunks = _groups(centres, np.array([r["n"] for r in held]), reach, rows, min(QUERY_BLOCK, fit), min(DATA_BLOCK, fit))
    return Plan(centres, radius, floor, group, reach, blocks, chunks, cells)


def _scores(q: pa.Array, x: pa.Array, width: int) -> Iterator[Array]:
    """A row of exact inner products with x for each vector of q; those beyond a long as its ends."""
    qf, xf = _matrix(q, width), _matrix(x, width)
    most_q, most_x = np.abs(qf).max(axis=1, initial=0), np.abs(xf).max(axis=1, initial=0)
    exact = most_q.max(initial=0) * most_x.max(initial=0) * width < EXACT
    qi, xi = (None, None) if exact else (_matrix(q, width, np.int64), _matrix(x, width, np.int64))
    for a in range(0, len(qf), TILE):
        tile = qf[a : a + TILE] @ xf.T
        for i, products in enumerate(tile, a):
            if exact:
                yield products.astype(np.int64)
                continue
            size = most_q[i] * most_x * width
            out = np.where(size < EXACT, products, 0).astype(np.int64)
            wide = np.flatnonzero((size >= EXACT) & (size < 2.0**62))
            out[wide] = xi[wide] @ qi[i]
            own = qi[i].tolist()
            for j in np.flatnonzero(size >= 2.0**62):  # rare: whole numbers of any size
                out[j] = max(-LONG - 1, min(LONG, sum(c * d for c, d in zip(own, xi[j].tolist(), strict=True))))
            yield out


def _solver(width: int, k: int):
    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[Array, Array, Array]] = [(np.zeros(0, dtype=np.int64),) * 3]
        if left.num_rows and right.num_rows:
            ids, own = right["id"].to_numpy(), left["id"].to_numpy()
            for i, scores in enumerate(_scores(left["v"].combine_chunks(), right["v"].combine_chunks(), width)):
                hits = np.flatnonzero(ids != own[i])
                if len(hits) > k:
                    hits = hits[scores[hits] >= np.partition(scores[hits], len(hits) - k)[len(hits) - k]]
                hits = hits[np.lexsort((ids[hits], ~scores[hits]))][:k]
                found.append((np.full(len(hits), own[i]), ids[hits], scores[hits]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return solve


def prepared(vectors: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, Array] | None:
    """Data (id, v, cell, ring, r, length), queries (id, v, cell, r, length) and pivots; None without data or
    queries."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("v")).where("id is not null and v is not null")
    rows = stage(rows.distinct(), "topk-rows")
    least = F.row_number().over(W.partitionBy("v").orderBy("id"))
    data = stage(rows.withColumn("n", least).where(F.col("n") <= k + 1).drop("n"), "topk-data")
    queries = rows.where(is_query)
    n = data.count()
    if not n or queries.isEmpty():
        return None
    width = rows.agg(F.max(F.size("v"))).first()[0]
    chosen = data.orderBy(F.xxhash64("id", F.lit(19)), "id", "v").limit(max(1, min(PIVOTS, n // ROWS_PER_PIVOT))).collect()  # a bounded number of pivots
    pivots = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in chosen], dtype=np.float64).reshape(len(chosen), width)
    data, queries = stage(in_cells(data, pivots), "topk-cells"), stage(in_cells(queries, pivots), "topk-queries")
    most = data.agg(F.max("r")).first()[0] or 1.0
    ring = F.least(F.lit(RINGS - 1), F.floor(F.col("r") / most * RINGS).cast("int"))
    return data.withColumn("ring", ring), queries, pivots


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows other than the query's own, for every row with
    is_query (a condition on `id`). Ties go to the smaller id.

    Rows with a null id, or a vector that is null or has null or non-finite components, take no part. Rows
    repeated with id and vector count once; where an id has several vectors each of them asks and is found, and
    the k best of all its pairs are returned. A row of a query's id is never among its hits. Vectors of different
    lengths are compared as if padded with zeros; empty ones score 0. Components are whole numbers of at most
    9.2e18 in size, scores are exact, and scores beyond a long are its least or largest value. No rows or no
    queries give an empty result; extra columns are not read.
    """
    found = prepared(vectors, is_query, k, scale, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data, queries, pivots = found
    plan = planned(data, queries, pivots, k)
    key = ["group", "block", "chunk"]
    hits = plan.asked(queries).groupBy(*key).cogroup(plan.sent(data).groupBy(*key)).applyInArrow(_solver(pivots.shape[1], k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
