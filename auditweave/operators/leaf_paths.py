"""Leaves of trained trees with the conditions on their paths, for exact attributions.

A path may test a feature several times; its tests are one interval ``low < value <= high``,
and their shares of training weight multiply. The table has one entry per leaf and feature;
its size follows from the model, not from the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, functions as F

from auditweave.operators.boosting import BoostedTrees
from auditweave.session import ensure_checkpoint_dir


@dataclass
class LeafPaths:
    """Arrays over leaves: ``value`` (leaves, classes), the others (leaves, features of the longest path)."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(found: list[tuple[np.ndarray, dict]], classes: int) -> LeafPaths:
        width = max([len(conditions) for _, conditions in found] + [1])
        shape = (len(found), width)
        paths = LeafPaths(
            np.zeros((len(found), classes)), np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        )
        for i, (value, conditions) in enumerate(found):
            paths.value[i] = value
            for j, (f, (low, high, share)) in enumerate(sorted(conditions.items())):
                paths.feature[i, j], paths.low[i, j], paths.high[i, j], paths.share[i, j] = f, low, high, share
        return paths

    def expected(self) -> np.ndarray:
        """Score of each class when no feature is known: leaves weighted by their training weight."""
        return (self.value * self.share.prod(axis=1)[:, None]).sum(axis=0)


def walk(root, node: Callable) -> list[tuple[object, dict]]:
    """(leaf, conditions) of one tree; ``node(key)`` is (feature or -1, threshold, left, right, cover)."""
    leaves, todo = [], [(root, {})]
    while todo:
        key, conditions = todo.pop()
        feature, threshold, left, right, cover = node(key)
        if feature < 0:
            leaves.append((key, conditions))
            continue
        low, high, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            part = node(child)[4] / cover if cover else 0.0
            if part > 0 and bounds[0] < bounds[1]:
                todo.append((child, conditions | {feature: (*bounds, share * part)}))
    return leaves


def of_boosted(model: BoostedTrees) -> LeafPaths:
    """Leaves in margin units; a leaf counts for the class of its tree."""
    found = []
    for t in range(len(model.feature)):
        def node(key, t=t):
            return int(model.feature[t, key]), float(model.threshold[t, key]), 2 * key, 2 * key + 1, float(model.cover[t, key])

        for key, conditions in walk(1, node):
            value = np.zeros(model.classes)
            value[t % model.classes] = model.value[t, key]
            found.append((value, conditions))
    return LeafPaths.of(found, model.classes)


def of_forest(model) -> LeafPaths:
    """Leaves of a Spark ML random forest; a class scores its share of the leaf, averaged over trees.

    The nodes are read from the saved form of the model, where each has its class weights.
    """
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.load(f"{path}/data")
    stored = saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved
    rows = stored.select(
        "treeID", "id", "impurityStats", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("threshold"),
        F.col("split.numCategories").alias("categories"),
    ).collect()
    trees: dict[int, dict] = {}
    for r in rows:
        if r["leftChild"] >= 0 and r["categories"] > 0:
            raise ValueError("categorical splits have no interval; encode categories as numbers")
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    found = []
    for nodes in trees.values():
        def node(key, nodes=nodes):
            r = nodes[key]
            inner = r["leftChild"] >= 0
            return (
                r["feature"] if inner else -1, r["threshold"][0] if inner else 0.0, r["leftChild"], r["rightChild"], sum(r["impurityStats"])
            )

        for key, conditions in walk(0, node):
            weights = np.array(nodes[key]["impurityStats"])
            found.append((weights / weights.sum() / len(trees), conditions))
    return LeafPaths.of(found, model.numClasses)


def of_model(classifier) -> LeafPaths:
    """Leaf paths of the classifier of a ``PhaseModel``."""
    if isinstance(classifier, BoostedTrees):
        return of_boosted(classifier)
    if isinstance(classifier, PipelineModel):
        return of_forest(classifier.stages[-1])
    return of_forest(classifier)
