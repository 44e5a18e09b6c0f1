"""Incremental clustering against distances computed in full."""

from hashlib import sha256

import numpy as np
import pytest

from auditweave.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, x array<int>"


def by_hand(rows, k=16, rounds=3, scale=64, dimensions=64):
    """{(id, vector): (cluster, distance)}, final centroids; every distance in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]))
    start = sorted(kept, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [list(v) for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if own:
                middle[j] = [sum(p) // len(own) for p in zip(*own)]
    return kept, assign(), middle


def rows_with_everything():
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=64) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 64) for i in range(300, 400)]  # a third of the rows are equal
    rows += [(7, rows[7][1]), (None, rows[9][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [float("nan")] * 64),
             (504, [float("inf")] + [0.0] * 63), (505, [None] + [0.0] * 63), (506, [0.0] * 64), (507, [-1e4] * 64)]
    return rows


def test_equals_full_distances(spark):
    rows = rows_with_everything()
    frame = spark.createDataFrame([(i, v, 1, 1, [1]) for i, v in rows], SCHEMA).repartition(7)
    table = centroids.assignment_table(centroids.cluster(frame)).collect()
    kept, found, middle = by_hand(rows)
    assert len(table) == len(kept) == 404
    wanted = sorted((-1 if i is None else i, c, d) for (i, _), (c, d) in zip(kept, found))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in table) == wanted
    for r in table:
        assert r.inertia == sum(d for _, d in found)
        assert r.cluster_inertia == sum(d for c, d in found if c == r.cluster)
        assert r.centroid_sha256 == sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_moved_dots_are_the_dots():
    draw = np.random.default_rng(1)
    x, old = draw.integers(-90, 90, (50, 64)), draw.integers(-90, 90, (16, 64))
    new = old.copy()
    new[3, [1, 60]] += 5
    new[4] = 0
    assert np.array_equal(centroids.moved(x, x @ old.T, old, new), x @ new.T)
    cluster, distance = centroids.nearest(x, x @ new.T, new)
    full = ((x[:, None, :] - new[None, :, :]) ** 2).sum(axis=2)
    assert np.array_equal(cluster, full.argmin(axis=1)) and np.array_equal(distance, full.min(axis=1))


def test_few_vectors_none_and_too_large(spark):
    few = spark.createDataFrame([(1, [1.0] * 64, 0, 0, [0]), (2, [1.0] * 64, 0, 0, [0])], SCHEMA)
    found = centroids.cluster(few)
    assert [(r.cluster, r.distance) for r in found.assigned.collect()] == [(0, 0), (0, 0)] and len(found.centroids) == 2
    nothing = centroids.assignment_table(centroids.cluster(spark.createDataFrame([], SCHEMA)))
    assert nothing.count() == 0
    assert nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [3e30] * 64, 0, 0, [0])], SCHEMA))


def test_other_lengths_and_scales(spark):
    rows = [(i, [float(i % 5), float(i % 7) / 3]) for i in range(60)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    found = centroids.cluster(frame, dimensions=2, scale=10, k=3, rounds=5)
    kept, wanted, middle = by_hand([(i, [np.float32(c) for c in v]) for i, v in rows], k=3, rounds=5, scale=10, dimensions=2)
    exact = [(i, [int(np.floor(c * 10)) for c in v]) for i, v in rows]
    assert len(found.centroids) == 3 and found.assigned.count() == 60
    if [v for _, v in exact] == [v for _, v in kept]:
        assert found.centroids == middle
        assert sorted(tuple(r) for r in found.assigned.collect()) == sorted((i, c, d) for (i, _), (c, d) in zip(kept, wanted))
