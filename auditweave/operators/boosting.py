"""Multi-class gradient boosting on feature histograms (second order, softmax over classes).

A round grows one tree per class, all of them level by level: every task sums the
derivatives of its rows per (class, node, feature, bin), one ``groupBy`` adds the tasks up,
and a running sum over the bins gives the gain of every split. The driver sees one row per
open node. Margins travel with the rows and are written out after each round.

Derivatives are summed as whole numbers of a fixed unit: sums of doubles depend on the order
in which tasks finish, and near ties would then pick other splits in another run.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from auditweave.operators import tree_kernel
from auditweave.session import cut_lineage, ship_by_value

ship_by_value(tree_kernel)
ship_by_value(sys.modules[__name__])

_SUMS = "class int, node int, feature int, bin int, first bigint, second bigint"
_NODES = "tree int, node int, feature int, threshold double, value double, cover double"


@dataclass
class BoostedTrees:
    """Fitted trees; tree ``t`` votes for class ``t % classes``. All arrays are (trees, nodes)."""

    classes: int
    depth: int
    n_features: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def empty(classes: int, depth: int, n_features: int) -> BoostedTrees:
        shape = (0, 2 << depth)
        return BoostedTrees(classes, depth, n_features, np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape))

    def with_round(self, grown: _Round, edges: list[np.ndarray]) -> BoostedTrees:
        limits = np.zeros(grown.bin.shape)
        for t, node in zip(*np.nonzero(grown.feature >= 0)):
            limits[t, node] = edges[grown.feature[t, node]][grown.bin[t, node]]
        stacked = [
            np.vstack(pair)
            for pair in ((self.feature, grown.feature), (self.threshold, limits), (self.value, grown.value), (self.cover, grown.cover))
        ]
        return BoostedTrees(self.classes, self.depth, self.n_features, *stacked, self.losses)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``probability``, a vector over the classes."""
        feature, threshold, value, classes, depth = self.feature, self.threshold, self.value, self.classes, self.depth

        @F.pandas_udf("array<double>")
        def probabilities(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=float).reshape(len(rows), -1)
            margins = np.zeros((len(x), classes))
            for t in range(len(feature)):
                margins[:, t % classes] += value[t, tree_kernel.leaves_reached(x, feature[t], threshold[t], depth)]
            return pd.Series(list(tree_kernel.softmax(margins)) if len(x) else [])

        return df.withColumn("probability", array_to_vector(probabilities(vector_to_array(features))))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per node that a row can reach, and one row of settings."""
        parents = np.arange(self.feature.shape[1]) // 2
        reached = (self.feature[:, parents] >= 0) & (parents > 0)
        reached[:, 1] = True
        t, node = np.nonzero(reached)
        rows = zip(t.tolist(), node.tolist(), *[a[t, node].tolist() for a in (self.feature, self.threshold, self.value, self.cover)])
        spark.createDataFrame(list(rows), _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        shape = (self.classes, self.depth, self.n_features, len(self.feature), [float(x) for x in self.losses])
        schema = "classes int, depth int, n_features int, trees int, losses array<double>"
        spark.createDataFrame([shape], schema).write.mode("overwrite").parquet(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        shape = spark.read.parquet(f"{path}/shape").first()
        arrays = [np.full((shape["trees"], 2 << shape["depth"]), empty) for empty in (-1, 0.0, 0.0, 0.0)]
        for r in spark.read.parquet(f"{path}/nodes").collect():
            for array, name in zip(arrays, ("feature", "threshold", "value", "cover")):
                array[r["tree"], r["node"]] = r[name]
        return BoostedTrees(shape["classes"], shape["depth"], shape["n_features"], *arrays, list(shape["losses"]))


@dataclass
class _Round:
    """The trees of one round while they grow, splits given by bins."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def blank(classes: int, depth: int) -> _Round:
        shape = (classes, 2 << depth)
        return _Round(np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape))


def bin_edges(df: DataFrame, features: str = "features", bins: int = 64) -> list[np.ndarray]:
    """Inner edges per feature: every value but the largest, or quantiles if there are more than ``bins``."""
    values = df.select(F.posexplode(vector_to_array(features)).alias("feature", "v")).select(
        "feature", F.when(~F.isnan("v"), F.col("v")).alias("v")
    )
    quantiles = [i / bins for i in range(1, bins)]
    summary = values.groupBy("feature").agg(
        F.approx_count_distinct("v", 0.02).alias("n"), F.percentile_approx("v", quantiles, 100 * bins).alias("q"), F.max("v").alias("top")
    ).collect()
    # few values by the estimate: their set has hardly more than ``bins`` members
    few = [r["feature"] for r in summary if r["n"] <= bins]
    sets = values.where(F.col("feature").isin(few)).groupBy("feature").agg(F.collect_set("v").alias("s")).collect() if few else []
    found = {r["feature"]: sorted(set(r["q"] or []) - {r["top"]}) for r in summary} | {r["feature"]: sorted(r["s"])[:-1] for r in sets}
    return [np.array(found[f], dtype=float) for f in sorted(found)]


def _binned(df: DataFrame, label: str, features: str, weight: str | None, edges: list[np.ndarray], classes: int) -> DataFrame:
    """(label, weight, bins, margins): what a round needs of a row, with margins of zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.empty((batch.num_rows, len(edges)), np.int32)
            for f, edge in enumerate(edges):
                bins[:, f] = np.searchsorted(edge, x[:, f], side="left")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(bins), _lists(np.zeros((batch.num_rows, classes)))],
                names=["label", "weight", "bins", "margins"],
            )

    rows = df.select(
        F.col(label).cast("int").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        vector_to_array(features).alias("x"),
    )
    return rows.mapInArrow(run, "label int, weight double, bins array<int>, margins array<double>")


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def level_sums(state: DataFrame, grown: _Round, open_nodes: np.ndarray, level: int, width: int, unit: float) -> DataFrame:
    """Sums of the derivatives per (class, node, feature, bin) over the open nodes.

    ``open_nodes`` is (classes, nodes of the level): is this node to be split? A task holds
    the sums of its rows, whose size follows from the settings. On the first level a row
    with class -1 carries the summed loss and weight.
    """
    classes = len(open_nodes)
    slots = 1 << level

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, mass = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bins, margins = _matrix(batch.column(2)), _matrix(batch.column(3))
            if sums is None:
                sums = np.zeros((classes, 2, slots, bins.shape[1], width), np.int64)
            first, second = (np.rint(d * unit) for d in tree_kernel.gradients(margins, label, weight))
            if level == 0:
                own = tree_kernel.softmax(margins)[np.arange(len(label)), label]
                loss += int(np.rint(-np.log(np.maximum(own, 1e-300)) * weight * unit).sum())
                mass += int(np.rint(weight * unit).sum())
            for c in range(classes):
                node = tree_kernel.leaves_reached(bins, grown.feature[c], grown.bin[c], level)
                slot = node - slots
                slot = np.where((slot >= 0) & open_nodes[c][np.maximum(slot, 0)], slot, -1)
                tree_kernel.add_histograms(sums[c], bins, slot, first[:, c], second[:, c])
        if sums is None:
            return
        at = np.nonzero(sums.any(axis=1))
        columns = [at[0], at[1] + slots, at[2], at[3], sums[at[0], 0, at[1], at[2], at[3]], sums[at[0], 1, at[1], at[2], at[3]]]
        if level == 0:
            columns = [np.append(c, v) for c, v in zip(columns, (-1, 0, 0, 0, loss, mass))]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        names = [n.split()[0] for n in _SUMS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    keys = ["class", "node", "feature", "bin"]
    return state.mapInArrow(run, _SUMS).groupBy(*keys).agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


def split_gains(sums: DataFrame, unit: float, lam: float = 1.0, min_child: float = 1.0) -> DataFrame:
    """(class, node, feature, bin, g, h, gl, hl, gain): every split; ``gain`` is NULL where a side is too light."""
    cell = Window.partitionBy("class", "node", "feature")
    up_to = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sums.select(
        "class", "node", "feature", "bin",
        (F.sum("first").over(cell) / unit).alias("g"), (F.sum("second").over(cell) / unit).alias("h"),
        (F.sum("first").over(up_to) / unit).alias("gl"), (F.sum("second").over(up_to) / unit).alias("hl"),
        (F.col("bin") == F.max("bin").over(cell)).alias("last"),
    )
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")

    def part(g, h):
        return g * g / (h + lam)

    gain = part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("g"), F.col("h"))
    heavy = ~F.col("last") & (F.col("hl") >= min_child) & (hr >= min_child)
    return placed.select("class", "node", "feature", "bin", "g", "h", "gl", "hl", F.when(heavy, gain).alias("gain"))


def best_splits(gains: DataFrame) -> DataFrame:
    """One row per (class, node): its sums and the split with the largest gain, if any; ties go to the first feature and bin."""
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    return gains.groupBy("class", "node").agg(
        F.first("g").alias("g"), F.first("h").alias("h"),
        F.max_by(F.struct("feature", "bin", "gl", "hl", "gain"), F.when(F.col("gain").isNotNull(), order)).alias("best"),
    )


def root_gains(
    df: DataFrame,
    label: str,
    *,
    classes: int,
    features: str = "features",
    weight: str | None = None,
    lam: float = 1.0,
    min_child: float = 1.0,
    bins: int = 64,
) -> DataFrame:
    """(class, feature, gain): the best first split by each feature, which tells what separates the classes."""
    edges = bin_edges(df, features, bins)
    state = cut_lineage(_binned(df, label, features, weight, edges, classes))
    mass = state.agg(F.sum("weight")).first()[0] or 1.0
    unit = _unit(mass)
    width = max([len(e) for e in edges] + [0]) + 1
    sums = level_sums(state, _Round.blank(classes, 0), np.ones((classes, 1), dtype=bool), 0, width, unit).where("class >= 0")
    gains = split_gains(sums, unit, lam, min_child)
    return gains.groupBy("class", "feature").agg(F.max("gain").alias("gain")).where(F.col("gain").isNotNull())


def _unit(mass: float) -> float:
    """Whole numbers per unit of a derivative: sums over all rows stay below 2^62."""
    return min(2.0**32, 2.0**61 / mass)


def _advanced(state: DataFrame, grown: _Round, depth: int) -> DataFrame:
    """Rows with the margins after a round."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _matrix(batch.column(2)), _matrix(batch.column(3)).copy()
            for c in range(margins.shape[1]):
                margins[:, c] += grown.value[c, tree_kernel.leaves_reached(bins, grown.feature[c], grown.bin[c], depth)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(margins)], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def fit(
    df: DataFrame,
    label: str,
    *,
    classes: int,
    features: str = "features",
    weight: str | None = None,
    rounds: int = 100,
    depth: int = 6,
    rate: float = 0.3,
    lam: float = 1.0,
    gamma: float = 0.0,
    min_child: float = 1.0,
    bins: int = 64,
) -> BoostedTrees:
    """Boosted trees for labels 0 to ``classes - 1``; ``losses`` has the mean log loss before each round and at the end."""
    edges = bin_edges(df, features, bins)
    model = BoostedTrees.empty(classes, depth, len(edges))
    state = cut_lineage(_binned(df, label, features, weight, edges, classes))
    mass = state.agg(F.sum("weight")).first()[0]
    if not mass or not edges:
        return model
    width = max(len(e) for e in edges) + 1
    unit = _unit(mass)
    for _ in range(rounds):
        grown = _Round.blank(classes, depth)
        open_nodes = np.ones((classes, 1), dtype=bool)
        for level in range(depth):
            sums = level_sums(state, grown, open_nodes, level, width, unit)
            if level == 0:
                sums = cut_lineage(sums)
                total = sums.where("class = -1").first()
                model.losses.append(total["first"] / total["second"])
                sums = sums.where("class >= 0")
            following = np.zeros((classes, 2 << level), dtype=bool)
            for r in best_splits(split_gains(sums, unit, lam, min_child)).collect():
                c, node, best = r["class"], r["node"], r["best"]
                if level == 0:
                    grown.value[c, node], grown.cover[c, node] = -rate * r["g"] / (r["h"] + lam), r["h"]
                if best is None or best["gain"] <= max(gamma, 1e-9):
                    continue
                grown.feature[c, node], grown.bin[c, node] = best["feature"], best["bin"]
                for child, g, h in ((2 * node, best["gl"], best["hl"]), (2 * node + 1, r["g"] - best["gl"], r["h"] - best["hl"])):
                    grown.value[c, child], grown.cover[c, child] = -rate * g / (h + lam), h
                    following[c, child - (2 << level)] = True
            open_nodes = following
            if not open_nodes.any():
                break
        model = model.with_round(grown, edges)
        state = cut_lineage(_advanced(state, grown, depth))
    last = level_sums(state, _Round.blank(classes, depth), np.zeros((classes, 1), dtype=bool), 0, width, unit)
    total = last.where("class = -1").first()
    model.losses.append(total["first"] / total["second"])
    return model
