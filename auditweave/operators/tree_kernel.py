"""Array work of decision trees inside tasks: histograms, scores, attributions.

Trees are rows of equally long arrays. Node 1 is the root, the children of node ``i`` are
``2 i`` (value at most the threshold) and ``2 i + 1``; ``feature`` is -1 at leaves. A NaN is
larger than every threshold.
"""

from __future__ import annotations

import numpy as np


def leaves_reached(values: np.ndarray, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """Node in which each row of ``values`` ends in one tree."""
    node = np.ones(len(values), dtype=np.int64)
    rows = np.arange(len(values))
    for _ in range(depth):
        split = feature[node]
        inner = split >= 0
        right = ~(values[rows, np.maximum(split, 0)] <= limit[node])
        node = np.where(inner, 2 * node + right, node)
    return node


def softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted log loss by the margin of each class."""
    p = softmax(margins)
    first = p.copy()
    first[np.arange(len(label)), label] -= 1.0
    return first * weight[:, None], p * (1.0 - p) * weight[:, None]


def add_histograms(sums: np.ndarray, bins: np.ndarray, slot: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Add one class of a batch to ``sums`` (2, slots, features, bins); rows with slot -1 are left out.

    The derivatives are whole numbers, so their sums do not depend on the order of rows.
    """
    _, slots, n_features, width = sums.shape
    inside = slot >= 0
    if not inside.any():
        return
    base = slot[inside] * width
    for f in range(n_features):
        at = base + bins[inside, f]
        for kind, values in enumerate((first, second)):
            counted = np.bincount(at, weights=values[inside], minlength=slots * width)
            sums[kind, :, f, :] += np.rint(counted).astype(np.int64).reshape(slots, width)


def attributions(
    values: np.ndarray, leaf_value: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, n_features: int
) -> np.ndarray:
    """Exact Shapley values of each row, summed over leaves.

    A leaf has up to D conditions ``low < value <= high``, one per feature of its path, and
    for each the ``share`` of training weight that meets it on the way; unused places have
    no bounds and share 1. With o = 1 where a row meets a condition, the leaf credits
    feature i with  value * (o_i - share_i) * integral over t in [0, 1] of the product over
    the other features j of (share_j (1 - t) + o_j t).  The integrand is a polynomial of
    degree D - 1, for which Gauss-Legendre nodes are exact.
    """
    n, (n_leaves, width) = len(values), feature.shape
    out = np.zeros((n, n_features))
    if not n_leaves or not width:
        return out
    values = np.where(np.isnan(values), np.inf, values)
    points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
    place = np.zeros((n_leaves * width, n_features))
    place[np.arange(n_leaves * width), feature.ravel()] = 1.0
    step = max(1, 4_000_000 // (n_leaves * width))
    for at in range(0, n, step):
        part = values[at : at + step][:, feature.ravel()].reshape(-1, n_leaves, width)
        met = ((part > low) & (part <= high)).astype(float)
        total = np.zeros_like(met)
        for point, weight in zip((points + 1) / 2, weights / 2):
            factor = share * (1 - point) + met * point
            total += weight * factor.prod(axis=2, keepdims=True) / factor
        credit = leaf_value[:, None] * (met - share) * total
        out[at : at + step] = credit.reshape(len(part), -1) @ place
    return out
