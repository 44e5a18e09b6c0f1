"""Isolation forest: hash-sampled trees built in parallel, scored with Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from auditweave.operators import forest_kernel
from auditweave.session import cut_lineage, ship_by_value

ship_by_value(forest_kernel)

_SPACE = 2**53


@dataclass
class IsolationForest:
    """Node table (at most trees * (2 psi - 1) rows) with its settings."""

    nodes: DataFrame
    columns: list[str]
    psi: int

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        spark.createDataFrame([(self.columns, self.psi)], "columns array<string>, psi int").write.mode(
            "overwrite"
        ).parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        settings = spark.read.parquet(f"{path}/settings").first()
        return IsolationForest(
            spark.read.parquet(f"{path}/nodes"), list(settings["columns"]), settings["psi"]
        )


def _draw(*parts: Column) -> Column:
    """Reproducible uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(_SPACE)) / float(_SPACE)


def _number_of_trees(draw: Column, trees: int, chance: float) -> Column:
    """How many of the trees take a row, if each does with ``chance``: binomial by inversion."""
    if chance >= 1.0:
        return F.lit(trees)
    steps, total = [], 0.0
    for k in range(trees):
        ways = lgamma(trees + 1) - lgamma(k + 1) - lgamma(trees - k + 1)
        total += exp(ways + k * log(chance) + (trees - k) * log1p(-chance))
        steps.append(total)
        if total >= 1.0 - 1e-15:
            break
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= draw))


def fit(
    df: DataFrame,
    columns: Sequence[str],
    *,
    row_id: str = "event_id",
    trees: int = 200,
    psi: int = 256,
    seed: int = 42,
) -> IsolationForest:
    """Each tree sees ``psi`` rows drawn by hash from the whole table.

    The table is scanned twice (count, draw) and never shuffled; only drawn rows are. One hash
    per row says how many trees take it; only rows that some tree takes are hashed per tree. A
    tree that got too few rows, which is unlikely, makes the draw start again with twice the chance.
    """
    n = df.count()
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    psi = min(psi, n)
    rows = df.select(
        F.col(row_id).alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    )
    draws = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda tree: F.struct(F.xxhash64(F.col("row_id"), tree, F.lit(seed + 2)).alias("draw"), tree.alias("tree")),
        )
    )
    ranked = Window.partitionBy("tree").orderBy("draw", "row_id")
    chance = 1.6 * psi / n + 30.0 / n
    while True:
        counted = rows.withColumn("k", _number_of_trees(_draw(F.col("row_id"), F.lit(seed + 1)), trees, chance))
        drawn = counted.where("k > 0").select("row_id", "x", F.inline(F.slice(draws, F.lit(1), F.col("k"))))
        samples = cut_lineage(drawn.withColumn("__r", F.row_number().over(ranked)).where(F.col("__r") <= psi))
        if chance >= 1.0 or samples.count() == psi * trees:
            break
        chance *= 2
    nodes = samples.select("tree", "row_id", "draw", "x").groupBy("tree").applyInPandas(
        forest_kernel.tree_builder(psi, seed), forest_kernel.NODE_SCHEMA
    )
    return IsolationForest(cut_lineage(nodes), list(columns), psi)


def score(df: DataFrame, model: IsolationForest, output: str = "if_anomaly_score") -> DataFrame:
    """Score in [0, 1], 4 decimals; higher is more anomalous.

    The node table has a fixed size, so it travels with the function.
    """
    packed = forest_kernel.pack(model.nodes.toPandas())
    run = F.pandas_udf(forest_kernel.scorer(packed, model.psi), T.DoubleType())
    return df.withColumn(
        output, run(F.array(*[F.col(c).cast("double") for c in model.columns]))
    )


def decision(column: str = "if_anomaly_score") -> Column:
    """The signed decision value that belongs to a score (negative = anomalous)."""
    return 0.5 - F.col(column)
