"""Threshold picks, campaigns, purity of splits, quality checks and dashboards."""

import random

import pytest
from helpers import at, by, rows
from pyspark.sql import functions as F

from auditweave.operators import campaigns, evaluate, monitor, quality


def scored(spark, pairs):
    return spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "s double, y int")


def test_sweep_finds_a_clean_gap(spark):
    random.seed(1)
    pairs = [(random.uniform(0, 0.4), 0) for _ in range(200)] + [(random.uniform(0.6, 1), 1) for _ in range(60)]
    best = evaluate.sweep(scored(spark, pairs), "s", "y").first()
    assert 0.4 < best["threshold"] <= 0.65
    assert best["f1"] == pytest.approx(1.0) and best["pr_auc"] == pytest.approx(1.0)


def test_lowest_threshold_wins_a_tie(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 1), (0.1, 0)]
    best = evaluate.sweep(scored(spark, pairs), "s", "y").first()
    assert best["threshold"] == 0.5
    floor = evaluate.sweep(scored(spark, pairs), "s", "y", "precision_floor", 0.6).first()
    assert (floor["threshold"], floor["precision"]) == (0.5, 0.6)
    unreachable = evaluate.sweep(scored(spark, [(0.9, 0), (0.5, 1), (0.1, 0)]), "s", "y", "precision_floor", 0.9).first()
    assert (unreachable["threshold"], unreachable["precision"]) == (0.5, 0.5)


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        evaluate.sweep(scored(spark, [(0.1, 0), (0.2, 0)]), "s", "y")
    with pytest.raises(ValueError):
        evaluate.pick_threshold(evaluate.pr_curve(scored(spark, [(0.1, 0), (0.2, 1)]), "s", "y"), "accuracy")


def test_auc_with_ties_against_pairs(spark):
    random.seed(2)
    pairs = [(random.randrange(12) / 10, random.random() < 0.4) for _ in range(150)]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, ya in pairs if ya for b, yb in pairs if not yb]
    curve = evaluate.pr_curve(scored(spark, pairs), "s", "y")
    assert evaluate.roc_auc(curve).first()[0] == pytest.approx(sum(wins) / len(wins))


def test_confusion_is_zero_guarded(spark):
    row = evaluate.confusion(scored(spark, [(0.1, 0)]), "s", "y", 0.5).first()
    assert (row["tn"], row["precision"], row["recall"], row["f1"], row["fpr"]) == (1, 0.0, 0.0, 0.0, 0.0)


LABELS = "event_id string, scenario string, actor string, timestamp timestamp"


def campaign(spark):
    hours = [0, 1.49, 2, 36.1, 37, 43]
    data = [(f"e{i}", "apt", "ann", at(h * 3600)) for i, h in enumerate(hours)]
    return spark.createDataFrame([*data, ("n", "benign_noise", "bob", at(0))], LABELS)


def test_campaigns_split_on_a_strict_gap(spark):
    mapped = campaigns.campaign_map(campaign(spark))
    got = by(mapped)
    assert "n" not in got and got["e2"]["campaign_id"] == "apt|ann|0" and got["e5"]["campaign_id"] == "apt|ann|1"
    diag = campaigns.campaign_diagnostics(mapped).first()
    assert tuple(diag) == (2, 6.0, 34.1)
    campaigns.expect_campaigns(mapped, 2)
    with pytest.raises(ValueError):
        campaigns.expect_campaigns(mapped, 3)


def test_campaign_recall_and_matched_precision(spark):
    mapped = campaigns.campaign_map(campaign(spark))
    values = {"e0": 0.1, "e1": 0.9, "e2": 0.2, "e3": 0.3, "e4": 0.3, "e5": 0.3}
    data = [(e, at(i), s, 1) for i, (e, s) in enumerate(values.items())] + [("b", at(9), 0.5, 0)]
    frame = spark.createDataFrame(data, "event_id string, timestamp timestamp, scaled_score double, is_attack int")
    steps = campaigns.campaign_scores(frame, mapped)
    got = campaigns.campaign_recall(steps, 0.6).first()
    assert (got["campaigns_detected"], got["n_campaigns"], got["median_first_detect_step"], got["median_frac_through"]) == (1, 2, 2.0, 0.667)
    curve = evaluate.pr_curve(frame, "scaled_score", "is_attack")
    point = campaigns.matched_precision(curve, 0.9).first()
    assert (point["reachable"], point["threshold"]) == (True, 0.9)
    report = campaigns.campaign_report(frame, steps, 0.6).first()
    assert report["campaign_vs_event_recall"] == pytest.approx(0.5 / (1 / 6))
    stray = frame.unionByName(spark.createDataFrame([("x", at(3), 0.1, 1)], frame.schema))
    with pytest.raises(ValueError):
        campaigns.campaign_scores(stray, mapped)


def test_compare_sets(spark):
    a = spark.createDataFrame([("x",), ("y",)], "campaign_id string")
    b = spark.createDataFrame([("y",), ("z",), ("w",)], "campaign_id string")
    got = campaigns.compare_sets(a, b).first()
    assert (got["shared"], got["only_a"], got["only_b"], got["jaccard"]) == (1, 1, 2, 0.25)
    assert campaigns.compare_sets(a.limit(0), b.limit(0)).first()["jaccard"] == 1.0


def test_leakage(spark):
    benign = spark.createDataFrame([("ann",), (None,)], "actor string")
    labels = spark.createDataFrame(
        [("ann", True, "svc"), ("eve", True, None), ("svc", True, None), ("bob", False, "")],
        "actor string, anomaly_flag boolean, created string")
    assert [r[0] for r in quality.leaky_identities(benign, labels).collect()] == ["eve"]
    with pytest.raises(ValueError):
        quality.assert_no_leak(benign, labels)
    quality.assert_no_leak(benign, labels.where("actor <> 'eve'"))


def test_collecting_no_labels_is_an_error(spark):
    with pytest.raises(ValueError):
        quality.collect_labels(spark.createDataFrame([], LABELS))


def test_overlap_guards_of_the_ablation(spark):
    frame = spark.createDataFrame([("e",)], "event_id string")
    with pytest.raises(ValueError):
        evaluate.require_disjoint(frame, frame, "event_id", "both")


def test_alert_line_round_trip(spark):
    alert = spark.createDataFrame(
        [("ent", "ann", "Put It", "azure", "Impact", 0.8907, at(0), 'says "hi"\nthere')],
        "entity_id string, principal string, action string, source_cloud string, predicted_phase string, "
        "scaled_score double, timestamp timestamp, text string")
    lines = monitor.alert_lines(alert, F.col("text"))
    got = rows(monitor.parse_alert_lines(lines))[0]
    assert (got["entity"], got["action"], got["risk"], got["phase_line"], got["narrative"], got["cloud"]) == (
        "ent", "Put It", 0.8907, "Impact", "says 'hi' there", "AZURE")
    assert monitor.parse_alert_lines(lines, clouds=["AWS"]).isEmpty()


def test_alert_lines_survive_missing_fields(spark):
    alert = spark.createDataFrame(
        [(1, at(0), "e", None, None, None, None, None, None, "AWS")],
        "event_id int, timestamp timestamp, entity_id string, principal string, action string, "
        "predicted_phase string, dominant_signal string, active_clouds array<string>, scaled_score double, "
        "source_cloud string",
    )
    for text in (None, F.lit(None).cast("string")):
        got = rows(monitor.parse_alert_lines(monitor.alert_lines(alert, text)))[0]
        assert (got["phase"], got["action"], got["risk"], got["principal"]) == ("Normal", "None", None, "e")
