"""Centroid clustering of integer vectors with an incremental distance matrix.

Every vector keeps its exact integer dot product with every centroid. When a centroid
moves, only the components that changed are multiplied: ``dot += x[c] * change[c]``; a
squared distance is then ``|x|^2 - 2 dot + |centroid|^2``, all in integers, and the nearest
centroid an argmin over one row of the matrix. The first dots come the same way, from
centroids of zeros. Vectors never move: each round reads the table of the round before and
writes the next one; what goes to the driver is one sum per centroid and component.

Defined cases: a vector that is null, has another number of components or holds a null, NaN
or infinite one takes no part and gives no row. Repeated rows and equal vectors each count.
With fewer vectors than centroids, every vector is a starting centroid; without vectors the
result is empty. A null id is hashed as the empty string. Columns other than the two named
are not read. A component beyond 2^27 after scaling would not leave the distances exact in
64 bits; it ends the run with an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.llm.common import discard, shared_path, slim

LIMIT = 1 << 27
STATE = "vec_id {id}, x array<int>, dots array<bigint>, cluster int, distance bigint"


@dataclass
class Clustering:
    """``assigned`` has ``vec_id``, ``cluster``, ``distance``; ``centroids`` is a list of integer lists."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertias: dict[int, int]


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dimensions: int, scale: float) -> DataFrame:
    """(vec_id, x): complete, finite vectors of the given length, scaled and rounded down."""
    source = slim(vectors, vec_id=vec_id, v=vector)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fits = F.forall(scaled, lambda c: c.between(-LIMIT, LIMIT))
    return source.where((F.size("v") == dimensions) & finite).select(
        "vec_id",
        F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("array<int>").alias("x"),
    )


def starting_hash(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def moved(x: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Dot products with ``new``, from those with ``old``, by the components that changed."""
    dots = dots.copy()
    for j, change in enumerate(new - old):
        at = np.flatnonzero(change)
        if len(at):
            dots[:, j] += x[:, at] @ change[at]
    return dots


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; ties go to the smaller number."""
    distances = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(x)), cluster]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _advance(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The table of the next round: dots moved from ``old`` to ``new`` and the new nearest."""
    width, schema = new.shape[1], STATE.format(id=dict(state.dtypes)["vec_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            x = _rows(column["x"], width)
            kept = _rows(column["dots"], len(old)) if "dots" in column else np.zeros((len(x), len(old)), np.int64)
            dots = moved(x, kept, old, new)
            cluster, distance = nearest(x, dots, new)
            yield pa.RecordBatch.from_arrays(
                [column["vec_id"], column["x"], _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "x", "dots", "cluster", "distance"],
            )

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Rounded-down means of the clusters; an empty cluster keeps its centroid. One row per cluster is collected."""
    sums = [F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    after = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return after


def cluster(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = 64,
    scale: float = 64,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
) -> Clustering:
    """Assign every vector, move the centroids, ``rounds`` times; then assign once more.

    Centroids start as the ``k`` vectors with the smallest hash of their id. The table of a
    round goes once the next one is written, so two of them exist at most.
    """
    spark = vectors.sparkSession
    source = whole_vectors(vectors, vec_id, vector, dimensions, scale)
    drawn = source.orderBy(starting_hash(F.col("vec_id"), seed), "x").limit(k).select("x").collect()
    if not drawn:
        empty = spark.createDataFrame([], STATE.format(id=dict(source.dtypes)["vec_id"]))
        return Clustering(empty.select("vec_id", "cluster", "distance"), [], {})
    centroids = np.array([r["x"] for r in drawn], dtype=np.int64)
    before, state, path = np.zeros_like(centroids), source, None
    for step in range(rounds + 1):
        following = shared_path(spark, f"distances-{step}")
        table = _advance(state, before, centroids)
        table.write.option("compression", "zstd").parquet(following)
        if path is not None:
            discard(spark, path)
        state, path = spark.read.schema(table.schema).parquet(following), following
        if step < rounds:
            before, centroids = centroids, _means(state, centroids)
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    return Clustering(
        state.select("vec_id", "cluster", "distance"), centroids.tolist(), {r["cluster"]: int(r["s"]) for r in sums}
    )


def assignment_table(found: Clustering) -> DataFrame:
    """Adds to each vector its cluster's inertia, the inertia of all and its centroid's digest."""
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of_cluster = F.array(*[F.lit(found.inertias.get(i, 0)).cast("long") for i in range(len(digests))] or [F.lit(0).cast("long")])
    names = F.array(*[F.lit(d) for d in digests] or [F.lit("")])
    return found.assigned.select(
        "vec_id", "cluster", "distance", F.get(of_cluster, "cluster").alias("cluster_inertia"),
        F.lit(sum(found.inertias.values())).cast("long").alias("inertia"), F.get(names, "cluster").alias("centroid_sha256"),
    )


def oracle(k: int = 16, dimensions: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """The clustering in SQL: every distance computed from the components in every round."""
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dimensions}),
parts AS MATERIALIZED (SELECT r, unnest(range({dimensions})) AS i, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (SELECT j, unnest(range({dimensions})) AS i, unnest(x) AS v FROM (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS j, x FROM kept) WHERE j < {k})"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (SELECT r, j, d FROM (
    SELECT p.r, c.j, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS d FROM parts p JOIN c{t} c USING (i) GROUP BY p.r, c.j)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} AS MATERIALIZED (SELECT a.j, p.i, sum(p.v) AS s, count(*) AS n FROM a{t} a JOIN parts p USING (r) GROUP BY a.j, p.i),
c{t + 1} AS MATERIALIZED (SELECT c.j, c.i, CASE WHEN m.n IS NULL THEN c.v
    ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS v FROM c{t} c LEFT JOIN m{t} m ON c.j = m.j AND c.i = m.i)"""
            )
    return ",\n".join(steps) + f"""
SELECT k.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, g.digest AS centroid_sha256
FROM kept k JOIN a{rounds} a USING (r) JOIN (
    SELECT j, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY j) g ON g.j = a.j"""
