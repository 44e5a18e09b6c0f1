"""Properties of the forest, the classifier, the attributions and the gate."""

import numpy as np
import pytest
from helpers import by, rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from auditweave.operators import classifier, explain, features, forest_kernel, iforest
from auditweave.plans.adapter import audit_events


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    frame = features.features(audit_events(spark, sf_dir)).drop(
        "anomaly_score", "predicted_phase", "phase_confidence")
    return frame.persist()


@pytest.fixture(scope="module")
def model(table):
    return classifier.fit_phase(table, trees=15, depth=5)


@pytest.fixture(scope="module")
def alerts(table, model):
    scored = classifier.score_phase(table, model).where("predicted_phase <> 'Normal'")
    return explain.attribute(scored, model, orders=4).persist()


def test_average_path():
    assert [forest_kernel.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest_kernel.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_ranks_outliers_and_is_reproducible(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(800)] + [(9000 + i, 9.0, -9.0, 9.0) for i in range(3)]
    frame = spark.createDataFrame(data, "event_id long, a double, b double, c double")
    fit = iforest.fit(frame.where("event_id < 9000"), ["a", "b", "c"], trees=50, psi=128)
    got = by(iforest.score(frame, fit))
    values = [r["if_anomaly_score"] for r in got.values()]
    assert 0.0 <= min(values) and max(values) <= 1.0
    inliers = sorted(r["if_anomaly_score"] for i, r in got.items() if i < 9000)
    assert min(got[9000 + i]["if_anomaly_score"] for i in range(3)) > inliers[-5]
    assert fit.nodes.select("tree").distinct().count() == 50
    again = iforest.fit(frame.where("event_id < 9000").repartition(7), ["a", "b", "c"], trees=50, psi=128)
    fit.save(str(tmp_path / "f"))
    loaded = iforest.IsolationForest.load(spark, str(tmp_path / "f"))
    for other in (again, loaded):
        assert {i: r["if_anomaly_score"] for i, r in by(iforest.score(frame, other)).items()} == {
            i: r["if_anomaly_score"] for i, r in got.items()}


def test_every_tree_draws_from_the_whole_table(spark):
    frame = spark.range(30_000).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("a"), (F.col("id") % 13).alias("b"))
    fit = iforest.fit(frame, ["a", "b"], trees=10, psi=64)
    assert fit.psi == 64 and fit.nodes.select("tree").distinct().count() == 10


def test_attack_score_is_one_minus_normal(table, model):
    out = classifier.score_phase(table, model)
    normal = model.class_names.index("Normal")
    bad = out.where(F.abs(F.col("anomaly_score") - F.round(1 - F.get("probs", F.lit(normal)), 4)) > 1e-9)
    assert bad.isEmpty()
    assert out.where(~F.col("anomaly_score").between(0, 1)).isEmpty()
    assert out.where(F.col("phase_confidence") != F.round(F.array_max("probs"), 4)).isEmpty()
    assert out.where("predicted_phase = threat_category").count() > 0.9 * out.count()


def test_fallback_without_a_normal_class(table, model):
    odd = classifier.PhaseModel(model.encoder, model.classifier, ["A", "B", "C"], model.feature_columns)
    out = classifier.score_phase(table.withColumn("if_anomaly_score", F.lit(0.42)), odd)
    assert out.select("anomaly_score").distinct().collect()[0][0] == 0.42


def test_bypass_sets_every_field(table):
    row = classifier.score_phase(table, None).first()
    assert (row["anomaly_score"], row["predicted_phase"], row["phase_confidence"], row["attributions"]) == (0.1, "Normal", 0.1, {})


def test_boosted_option(table):
    fitted = classifier.fit_phase(table, algorithm="boosted", trees=3, depth=3)
    out = classifier.score_phase(table, fitted)
    total = F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)
    assert out.where(F.abs(total - 1) > 1e-9).isEmpty()


def test_bundle_round_trip(spark, table, model, tmp_path):
    model.threshold = 0.37
    model.save(str(tmp_path / "m"))
    loaded = classifier.PhaseModel.load(spark, str(tmp_path / "m"))
    assert (loaded.class_names, loaded.feature_columns, loaded.threshold) == (model.class_names, model.feature_columns, 0.37)
    assert loaded.background.count() == model.background.count()
    a = {r["event_id"]: r["anomaly_score"] for r in classifier.score_phase(table, model).collect()}
    assert a == {r["event_id"]: r["anomaly_score"] for r in classifier.score_phase(table, loaded).collect()}


def test_shapley_values_add_up(spark, table, model):
    scored = classifier.score_phase(table, model).where("predicted_phase <> 'Normal'").limit(20).persist()
    sums = explain.shapley(scored, model, orders=4).groupBy("event_id").agg(F.sum("impact").alias("s"))
    picked = model.background.orderBy(F.xxhash64("event_id", F.lit(42)), "event_id").limit(4)
    base = classifier.probabilities(model, picked).agg(*[F.avg(F.get("probs", F.lit(i))) for i in range(len(model.class_names))]).first()
    got = scored.join(sums, "event_id").collect()
    assert len(got) == 20
    for r in got:
        c = r["predicted_phase_index"]
        assert r["s"] == pytest.approx(r["probs"][c] - base[c], abs=1e-9)


def test_top_three_attributions(alerts):
    for r in rows(alerts.select("attributions", "login_result_success").limit(50)):
        assert len(r["attributions"]) == 3
        if "login_result_success" in r["attributions"]:
            assert r["attributions"]["login_result_success"]["raw_value"] == str(r["login_result_success"])


def test_gate_passes_for_drivers_and_fails_closed(alerts, model):
    gated = explain.faithfulness(alerts, model).persist()
    assert gated.where("passed_gate").count() > 0
    bad = gated.where("passed_gate and not (attributed_drop >= 0.15 and attributed_drop > control_drop)")
    assert bad.isEmpty()
    kind = alerts.schema["attributions"].dataType
    weak = F.map_filter("attributions", lambda k, v: F.lit(False))
    for damaged in (alerts.withColumn("attributions", weak), alerts.withColumn("attributions", F.lit(None).cast(kind))):
        assert explain.faithfulness(damaged, model).where("passed_gate").isEmpty()
    no_background = classifier.PhaseModel(model.encoder, model.classifier, model.class_names, model.feature_columns)
    assert explain.faithfulness(alerts, no_background).where("passed_gate").isEmpty()
    passed, review = explain.route(gated, F.lit("text"))
    assert passed.count() + review.count() == gated.count()
    assert {r["narrative"] for r in review.collect()} <= {explain.MANUAL_REVIEW}


def test_control_sets_are_drawn_once_per_trial(alerts, model):
    plan = explain.faithfulness(alerts, model)._jdf.queryExecution().optimizedPlan().toString()
    drawing = [line for line in plan.splitlines() if "md5(" in line]
    assert drawing and all("Generate" in line for line in drawing)


def test_gate_compiles_its_draws(alerts, model):
    plan = explain.faithfulness(alerts, model)._jdf.queryExecution().optimizedPlan().toString()
    drawing = "".join(line for line in plan.splitlines() if "md5(" in line)
    assert "lambdafunction(named_struct(h, md5" not in drawing and "array_sort" not in drawing


def test_exact_attributions_rank_without_a_shuffle(table, model):
    scored = classifier.score_phase(table, model).where("predicted_phase <> 'Normal'").limit(40).persist()
    got = explain.attribute(scored, model)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(" not in plan and "collect_list(" not in plan
    impacts = by(explain.exact_shapley(scored, model))
    for r in rows(got.select("event_id", "attributions")):
        values = impacts[r["event_id"]]["impacts"]
        first = sorted(range(len(values)), key=lambda i: (-abs(values[i]), i))[:3]
        assert set(r["attributions"]) == {model.feature_columns[i] for i in first}


def test_signature_ignores_order_and_buckets_confidence(spark):
    frame = spark.sql(
        """SELECT 'P' AS predicted_phase, map('a', 1, 'b', 2) AS attributions, 0.94D AS phase_confidence
        UNION ALL SELECT 'P', map('b', 5, 'a', 9), 0.89D UNION ALL SELECT 'Q', map('a', 1, 'b', 2), 0.94D
        UNION ALL SELECT 'P', map('a', 1, 'b', 2), 0.51D""")
    got = [r[0] for r in frame.select(explain.alert_signature()).collect()]
    import hashlib

    assert got[0] == got[1] == hashlib.sha256(b"P|['a', 'b']|0.9").hexdigest()
    assert len(set(got)) == 3


def test_background_is_deterministic(model, table):
    assert model.background.count() == 100
    medians = classifier.background_medians(model.background)
    data = np.array([r[0] for r in model.background.select(vector_to_array("features")).collect()])
    assert medians == pytest.approx(list(np.median(data, axis=0)))


def test_leave_one_group_out(table):
    early = F.col("event_id") % 2 == 0
    attack = F.col("is_attack") == 1
    attacks = table.where(attack | early).withColumn("scenario", F.when(attack, F.col("home_cloud")).otherwise("benign_noise"))
    out = classifier.leave_one_group_out(attacks, table.where(~attack & ~early), trees=5, depth=3)
    got = by(out, "held_out")
    assert set(got) == {"AWS", "AZURE", "GCP", "MEAN"}
    folds = [got[c] for c in ("AWS", "AZURE", "GCP")]
    assert got["MEAN"]["roc_auc"] == pytest.approx(sum(f["roc_auc"] for f in folds) / 3)
    assert all(f["n_test_attack"] > 0 and f["roc_auc"] > 0.8 for f in folds)
