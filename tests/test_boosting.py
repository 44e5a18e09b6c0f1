"""Boosted trees against brute-force splits, attributions against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from auditweave.operators import boosting, classifier, explain, leaf_paths, tree_kernel

NAMES = ["a", "b", "c", "d"]


def draw(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 30, n) / 4, rng.integers(0, 2, n)]).astype(float)
    label = ((x[:, 0] > 4) & (x[:, 1] < 2)).astype(int) + 2 * ((x[:, 2] > 5) & (x[:, 3] == 1))
    label = np.minimum(label, 2)
    flip = rng.random(n) < 0.1
    label[flip] = rng.integers(0, 3, flip.sum())
    return x, label, rng.integers(1, 4, n).astype(float)


@pytest.fixture(scope="module")
def frame(spark):
    x, label, weight = draw()
    rows = [(i, *map(float, v), int(y), float(w)) for i, (v, y, w) in enumerate(zip(x, label, weight))]
    table = spark.createDataFrame(rows, "event_id long, a double, b double, c double, d double, label int, weight double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(table).repartition(5).persist()


@pytest.fixture(scope="module")
def model(frame):
    return boosting.fit(frame, "label", classes=3, weight="weight", rounds=4, depth=3)


def grown_by_hand(x, label, weight, rounds, depth, rate=0.3, lam=1.0, min_child=1.0):
    """Margins after boosting with every value of every feature as a candidate."""
    margins = np.zeros((len(x), 3))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        change = np.zeros_like(margins)
        for c in range(3):
            g, h = weight * (p[:, c] - (label == c)), weight * p[:, c] * (1 - p[:, c])

            def grow(rows, level):
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-9, None)
                for f in range(x.shape[1] if level < depth else 0):
                    for v in np.unique(x[:, f])[:-1]:
                        left = rows[x[rows, f] <= v]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl < min_child or H - hl < min_child:
                            continue
                        gain = gl**2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G**2 / (H + lam)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, v))
                if best[1] is None:
                    change[rows, c] = -rate * G / (H + lam)
                    return
                f, v = best[1]
                grow(rows[x[rows, f] <= v], level + 1)
                grow(rows[x[rows, f] > v], level + 1)

            grow(np.arange(len(x)), 0)
        margins += change
    return margins


def test_trees_equal_a_brute_force_search(frame, model):
    x, label, weight = draw()
    expected = grown_by_hand(x, label, weight, 4, 3)
    expected = np.exp(expected) / np.exp(expected).sum(axis=1, keepdims=True)
    got = {r.event_id: r.p for r in model.transform(frame).select("event_id", vector_to_array("probability").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], expected, atol=1e-6)


def test_log_loss_falls_with_every_round(model):
    assert len(model.losses) == 5 and model.losses[0] == pytest.approx(math.log(3), abs=1e-6)
    assert all(later < earlier for earlier, later in zip(model.losses, model.losses[1:]))


def test_same_trees_from_other_partitions(frame, model):
    again = boosting.fit(frame.repartition(11), "label", classes=3, weight="weight", rounds=4, depth=3)
    for name in ("feature", "threshold", "value", "cover"):
        assert np.array_equal(getattr(model, name), getattr(again, name))


def test_save_and_load(spark, frame, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert loaded.losses == pytest.approx(model.losses)
    a, b = ({r[0]: list(r[1]) for r in m.transform(frame).select("event_id", "probability").collect()} for m in (model, loaded))
    assert a == b


def test_nan_and_many_values_and_constants(spark):
    rows = [(i, float(i), float("nan") if i % 3 else 1.0, 5.0, int(i >= 500)) for i in range(1_000)]
    table = spark.createDataFrame(rows, "event_id long, a double, b double, c double, label int")
    table = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(table)
    edges = boosting.bin_edges(table, bins=16)
    assert len(edges) == 3 and 10 <= len(edges[0]) <= 15 and len(edges[2]) == 0
    fitted = boosting.fit(table, "label", classes=2, rounds=3, depth=2, bins=16)
    right = fitted.transform(table).where((F.get(vector_to_array("probability"), F.lit(1)) > 0.5).cast("int") == F.col("label")).count()
    assert right >= 900 and set(fitted.feature[fitted.feature >= 0]) <= {0, 1}
    none = boosting.fit(table.where("a < 0"), "label", classes=2, rounds=2)
    assert len(none.feature) == 0


def shapley_by_subsets(x, tree, n):
    """Shapley values from the definition; an unknown feature goes both ways by training weight."""

    def score(known, key):
        feature, threshold, left, right, cover, value = tree(key)
        if feature < 0:
            return value
        if feature in known:
            return score(known, left if x[feature] <= threshold else right)
        return sum(tree(k)[4] / cover * score(known, k) for k in (left, right) if tree(k)[4])

    out = np.zeros(n)
    for i in range(n):
        for size in range(n):
            for rest in itertools.combinations([j for j in range(n) if j != i], size):
                part = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[i] += part * (score({*rest, i}, ROOT[0]) - score(set(rest), ROOT[0]))
    return out


ROOT = [1]


def test_boosted_attributions_equal_all_subsets(frame, model):
    paths = leaf_paths.of_model(model)
    x, _, _ = draw()
    for c in range(3):
        own = np.flatnonzero(paths.value[:, c])
        got = tree_kernel.attributions(x[:25], paths.value[own, c], *[a[own] for a in (paths.feature, paths.low, paths.high, paths.share)], 4)
        margins = np.zeros(25)
        for t in range(c, len(model.feature), 3):
            margins += model.value[t, tree_kernel.leaves_reached(x[:25], model.feature[t], model.threshold[t], 3)]
        assert np.allclose(got.sum(axis=1), margins - paths.expected()[c], atol=1e-9)
        for row in range(6):
            expected = np.zeros(4)
            for t in range(c, len(model.feature), 3):
                def tree(key, t=t):
                    return int(model.feature[t, key]), model.threshold[t, key], 2 * key, 2 * key + 1, model.cover[t, key], model.value[t, key]
                ROOT[0] = 1
                expected += shapley_by_subsets(x[row], tree, 4)
            assert np.allclose(got[row], expected, atol=1e-9)


def test_forest_attributions_add_up_and_equal_all_subsets(spark, frame):
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=5, maxDepth=4, seed=1).fit(frame)
    paths = leaf_paths.of_model(forest)
    scored = forest.transform(frame).select("event_id", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).limit(30).collect()
    x = np.array([r.x for r in scored])
    for c in range(3):
        got = tree_kernel.attributions(x, paths.value[:, c], paths.feature, paths.low, paths.high, paths.share, 4)
        assert np.allclose(got.sum(axis=1), [r.p[c] - paths.expected()[c] for r in scored], atol=1e-9)
    nodes = {}
    path = "/".join([str(spark.sparkContext.getCheckpointDir()), "forest-in-test"])
    forest.write().overwrite().save(path)
    saved = spark.read.load(f"{path}/data")
    for r in (saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved).collect():
        nodes[r.treeID, r.id] = r
    c, expected = 1, np.zeros((4, 4))
    for t in range(5):
        def tree(key, t=t):
            r = nodes[t, key]
            stats, inner = r.impurityStats, r.leftChild >= 0
            return (r.split.featureIndex if inner else -1, r.split.leftCategoriesOrThreshold[0] if inner else 0.0,
                    r.leftChild, r.rightChild, sum(stats), stats[c] / sum(stats) / 5)
        ROOT[0] = 0
        for row in range(4):
            expected[row] += shapley_by_subsets(x[row], tree, 4)
    got = tree_kernel.attributions(x[:4], paths.value[:, c], paths.feature, paths.low, paths.high, paths.share, 4)
    assert np.allclose(got, expected, atol=1e-9)


def test_exact_impacts_of_alerts(frame, model):
    phase = classifier.PhaseModel(None, model, ["x", "y", "z"], NAMES)
    scored = classifier.probabilities(phase, frame).withColumn("predicted_phase_index", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    paths = leaf_paths.of_model(model)
    rows = explain.exact_shapley(scored, phase).join(scored.select("event_id", "predicted_phase_index", vector_to_array("features").alias("x")), "event_id").collect()
    assert len(rows) == 400
    for r in rows:
        c = r.predicted_phase_index
        x = np.array([r.x])
        margin = sum(model.value[t, tree_kernel.leaves_reached(x, model.feature[t], model.threshold[t], 3)][0] for t in range(c, len(model.feature), 3))
        assert sum(r.impacts) == pytest.approx(margin - paths.expected()[c], abs=1e-9)
    top = explain.attribute(scored, phase, k=2).first()
    assert len(top["attributions"]) == 2
