"""Connected components over an edge table, with DataFrame operations only.

Large-star and small-star steps alternate: every node points to the smallest node of its
neighbourhood until the edges are stars. Minima are aggregated before the shuffle and
joined back, so a node with a third of all edges is split like any skewed join key. The
edge table is written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditweave.llm.common import stored


def _to_minimum(edges: DataFrame, own: str, other: str) -> DataFrame:
    """Every edge with the smallest node among ``own`` and its ``other`` ends."""
    smallest = edges.groupBy(own).agg(F.min(other).alias("__m"))
    return edges.join(smallest, own).withColumn("__m", F.least("__m", own))


def connected(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) of all nodes that have an edge.

    Self loops and rows with a null end are ignored, repeated edges count once. No edge
    gives an empty table.
    """
    current = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.union(current.select("v", "u"))
        large = _to_minimum(both, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("__m").alias("v"))
        small = _to_minimum(large.where(F.col("u") != F.col("v")).distinct(), "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("__m").alias("v")).union(small.select("u", F.col("__m").alias("v")))
        current = stored(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        before, mark = mark, _mark(current)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("node", F.col("node").alias("label"))
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes; equal when a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
