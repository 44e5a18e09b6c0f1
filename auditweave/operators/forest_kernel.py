"""Numpy helpers of the isolation forest, run inside tasks (Liu, Ting and Zhou 2008)."""

from __future__ import annotations

import numpy as np
import pandas as pd

EULER = 0.5772156649015329
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, lower int, upper int, length double"
)


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def tree_builder(psi, seed):
    """Function for ``applyInPandas``: one sample of at most psi rows -> its node rows."""
    limit = int(np.ceil(np.log2(max(psi, 2))))

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        data = np.vstack(sample.sort_values(["draw", "row_id"])["x"].to_numpy())
        random = np.random.default_rng([seed, tree])
        rows, todo = [], [(0, np.arange(len(data)), 0)]
        issued = 1
        while todo:
            node, members, depth = todo.pop()
            block = data[members]
            low, high = block.min(axis=0), block.max(axis=0)
            choices = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(choices) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(members))))
                continue
            feature = int(random.choice(choices))
            cut = float(random.uniform(low[feature], high[feature]))
            below = block[:, feature] <= cut
            lower, upper = issued, issued + 1
            issued += 2
            rows.append((tree, node, feature, cut, lower, upper, 0.0))
            todo.append((lower, members[below], depth + 1))
            todo.append((upper, members[~below], depth + 1))
        names = ["tree", "node", "feature", "threshold", "lower", "upper", "length"]
        return pd.DataFrame(rows, columns=names)

    return build


def pack(nodes: pd.DataFrame):
    """Node rows to rectangular arrays indexed by [tree, node]."""
    trees = sorted(nodes["tree"].unique())
    shape = (len(trees), int(nodes["node"].max()) + 1)
    slot = nodes["tree"].map({t: i for i, t in enumerate(trees)}).to_numpy()
    at = (slot, nodes["node"].to_numpy())
    packed = {}
    for name, kind in (("feature", "i4"), ("threshold", "f8"), ("lower", "i4"),
                       ("upper", "i4"), ("length", "f8")):
        packed[name] = np.zeros(shape, dtype=kind)
        packed[name][at] = nodes[name].to_numpy()
    return packed


def scorer(packed, psi):
    """Function from a Series of feature arrays to anomaly scores in [0, 1]."""
    norm = average_path(psi) or 1.0

    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        x = np.vstack(vectors.to_numpy())
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(packed["feature"].shape[0]):
            node = np.zeros(len(x), dtype="i4")
            while True:
                feature = packed["feature"][t][node]
                inner = feature >= 0
                if not inner.any():
                    break
                below = x[rows, np.where(inner, feature, 0)] <= packed["threshold"][t][node]
                child = np.where(below, packed["lower"][t][node], packed["upper"][t][node])
                node = np.where(inner, child, node)
            total += packed["length"][t][node]
        mean = total / packed["feature"].shape[0]
        return pd.Series(np.round(np.clip(2.0 ** (-mean / norm), 0.0, 1.0), 4))

    return score
