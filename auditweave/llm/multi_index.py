"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own centroids; a pair of
centroids is a cell. A query walks the cells by the sum of its two squared distances with
a heap (multi-sequence traversal) until the cells seen hold a ``share`` of the entries
(4,096 at least); these are reranked by the exact cosine of the original vectors in double precision.

Entries lie in blocks of bounded size: small cells side by side, a large cell in several.
A task holds one block and streams the queries that reach it, each with its cells; it
returns the best few of a block, so no row per pair is shuffled.

Centroids are fitted on at most ``sample`` vectors (smallest hashes of their ids); every
vector is indexed. The index keeps, of equal vectors, the ``top + 1`` smallest ids: others
cannot be among the nearest ``top``, as ties go to smaller ids. So a vector that a third of
all rows repeat costs a query no more than any other. At most ``max_cells`` centroids per
half, so that cells are a table of bounded size.

The default share serves vectors without structure (equal spread in all directions), for
which recall 0.9 needs about a third of the entries; clustered vectors need far less.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components
and vectors of another length than the most frequent take no part; repeated rows of one id
count once; without other candidates a query has no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditweave.llm.common import slim, stored
from auditweave.llm.words import mix

SAMPLE, MAX_CELLS, SHARE, LEAST, TOP, BLOCK = 20_000, 96, 0.36, 4_096, 5, 2_048


def usable(rows: DataFrame) -> DataFrame:
    """Distinct (id, vector) that take part, vectors in double precision."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    nonzero = F.exists("vector", lambda x: x != 0)
    good = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & nonzero
    )
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return good.where(F.size("vector") == (length["n"] if length else 0))


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of k-means; empty clusters move to the points farthest from theirs."""
    draw = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[draw.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        distance = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
        own = distance.argmin(axis=1)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(points[order], np.concatenate([[0], np.cumsum(count[filled])[:-1]]), axis=0)
        centres[filled] = sums / count[filled][:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = points[np.argsort(-distance.min(axis=1))[: len(empty)]]
    return centres


class MultiIndex:
    """Centroids of both halves, and the entries per cell once they are counted."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left, right
        self.counts = np.zeros(len(left) * len(right), dtype=np.int64)
        self.first = np.zeros_like(self.counts)
        self.blocks = np.zeros_like(self.counts)

    def place(self, counts: dict[int, int], size: int = BLOCK) -> None:
        """Deal the cells to blocks of about ``size`` entries, in cell order."""
        block, held = 0, 0
        for cell, n in sorted(counts.items()):
            self.counts[cell] = n
            if held and held + n > size:
                block, held = block + 1, 0
            self.first[cell], self.blocks[cell] = block, -(-n // size)
            block, held = (block, held + n) if n <= size else (block + self.blocks[cell], 0)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        cut = self.left.shape[1]
        out = []
        for part, centres in ((unit[:, :cut], self.left), (unit[:, cut:], self.right)):
            out.append((part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1))
        return out[0], out[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        left, right = self.distances(vectors)
        return left.argmin(axis=1) * len(self.right) + right.argmin(axis=1)

    def walk(self, left: np.ndarray, right: np.ndarray, wanted: int) -> list[int]:
        """Non-empty cells by ascending sum of distances until they hold ``wanted`` entries."""
        counts = self.counts
        a, b = np.argsort(left), np.argsort(right)
        x, y = left[a], right[b]
        queue, seen, found, held = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], 0
        while queue and held < wanted:
            _, i, j = heapq.heappop(queue)
            cell = int(a[i]) * len(b) + int(b[j])
            if counts[cell]:
                found.append(cell)
                held += int(counts[cell])
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(queue, (x[i2] + y[j2], i2, j2))
        return found


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def build(vectors: DataFrame, sample: int = SAMPLE, max_cells: int = MAX_CELLS, top: int = TOP, seed: int = 1) -> tuple[MultiIndex, DataFrame]:
    """The index and its stored entries (cell, id, vector) for the rows of :func:`usable`."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = stored(vectors.dropDuplicates(["id", "vector"]).withColumn("rank", rank).where(F.col("rank") <= top + 1).drop("rank"), "entries")
    drawn = entries.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vector").collect()
    if not drawn:
        index = MultiIndex(np.zeros((1, 1)), np.zeros((1, 1)))
        index.place({})
        return index, entries.select(F.lit(0).cast("long").alias("cell"), "id", "vector")
    points = np.array([r["vector"] for r in drawn], dtype=np.float64)
    points /= np.linalg.norm(points, axis=1)[:, None]
    cut = (points.shape[1] + 1) // 2
    k = max(1, min(max_cells, math.isqrt(entries.count())))
    left = lloyd(points[:, :cut], k, seed=seed)
    right = lloyd(points[:, cut:], k, seed=seed + 1) if points.shape[1] > 1 else np.zeros((1, 0))
    index = MultiIndex(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_matrix(batch.column(1), batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], names=["cell", "id", "vector"])

    placed = stored(entries.select("id", "vector").mapInArrow(run, "cell long, id long, vector array<double>"), "cells")
    # at most max_cells squared rows
    index.place({row["cell"]: row["count"] for row in placed.groupBy("cell").count().collect()})
    return index, placed


_ROWS = "block long, kind int, id long, vector array<double>, cells array<long>"


def search(index: MultiIndex, entries: DataFrame, queries: DataFrame, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for each (id, vector)."""
    wanted = max(LEAST, math.ceil(share * int(index.counts.sum())))
    names = ["block", "kind", "id", "vector", "cells"]

    def lists(groups: list) -> pa.Array:
        ends = np.cumsum([0, *map(len, groups)])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(groups).astype(np.int64)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = index.distances(_matrix(batch.column(1), batch.num_rows))
            for begin in range(0, batch.num_rows, 64):
                rows, blocks, cells = [], [], []
                for at in range(begin, min(begin + 64, batch.num_rows)):
                    found = np.array(index.walk(left[at], right[at], wanted))
                    every = np.repeat(found, index.blocks[found])
                    turn = np.arange(len(every)) - np.repeat(np.cumsum(index.blocks[found]) - index.blocks[found], index.blocks[found])
                    block = index.first[every] + turn
                    order = np.argsort(block, kind="stable")
                    starts = np.flatnonzero(np.diff(block[order], prepend=-1))
                    blocks += block[order][starts].tolist()
                    cells += np.split(every[order], starts[1:])
                    rows += [at] * len(starts)
                take = pa.array(rows, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, type=pa.int64()), pa.array(np.ones(len(rows), dtype=np.int32)),
                     batch.column(0).take(take), batch.column(1).take(take), lists(cells)], names=names,
                )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(0).to_numpy()
                turn = mix(batch.column(1).to_numpy().astype(np.uint64)) % index.blocks[cell].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.first[cell] + turn.astype(np.int64)), pa.array(np.zeros(len(cell), dtype=np.int32)),
                     batch.column(1), batch.column(2), lists(cell[:, None])], names=names,
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, cells, ready = None, [], [], [], False
        for batch in batches:
            block_of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(block_of) | np.diff(kind)) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(begin, end - begin)
                if not part.num_rows:
                    continue
                if block_of[begin] != block:
                    block, ids, vectors, cells, ready = block_of[begin], [], [], [], False
                if kind[begin] == 0:
                    ids.append(part.column(2).to_numpy())
                    vectors.append(_matrix(part.column(3), part.num_rows))
                    cells.append(part.column(4).flatten().to_numpy())
                elif ids:
                    if not ready:
                        ids, vectors, cells, ready = [np.concatenate(ids)], [np.concatenate(vectors)], [np.concatenate(cells)], True
                    for at in range(0, part.num_rows, 256):
                        yield from _best(part.slice(at, 256), ids[0], vectors[0], cells[0], top)

    asked = queries.select("id", "vector").mapInArrow(probe, _ROWS)
    kept = entries.select("cell", "id", "vector").mapInArrow(store, _ROWS)
    dealt = kept.union(asked).repartition("block").sortWithinPartitions("block", "kind")
    scored = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best(asked: pa.RecordBatch, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """The ``top`` entries of a block for each query that reaches it, by exact cosine."""
    queries = asked.column(2).to_numpy()
    wanted = _matrix(asked.column(3), asked.num_rows)
    groups = asked.column(4)
    flat, ends = groups.flatten().to_numpy(), np.cumsum(groups.value_lengths().to_numpy())
    rough = wanted @ vectors.T / np.linalg.norm(vectors, axis=1)
    out = [[], [], []]
    known, place = np.unique(cells, return_inverse=True)
    for at, (query, begin, end) in enumerate(zip(queries, [0, *ends], ends)):
        reached = np.isin(known, flat[begin:end])[place] & (ids != query)
        near = np.flatnonzero(reached)
        if not len(near):
            continue
        values = rough[at, near]
        if len(near) > top:
            # all that may be among the best, ties and rounding included
            near = near[values >= np.partition(values, -top)[-top] - 1e-9 * np.linalg.norm(wanted[at])]
        a, b = wanted[at], vectors[near]
        score = (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
        order = np.lexsort((ids[near], -score))[:top]
        out[0] += [query] * len(order)
        out[1] += ids[near][order].tolist()
        out[2] += score[order].tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"]
    )


def neighbours(rows: DataFrame, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, share: float = SHARE, **fit) -> DataFrame:
    """Index all vectors and search with those whose id is divisible by ``every``."""
    good = usable(slim(rows, id=vec_id, vector=vector))
    index, entries = build(good, top=top, **fit)
    return search(index, entries, good.where(F.col("id") % every == 0).dropDuplicates(["id"]), top, share)
