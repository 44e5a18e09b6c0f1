"""Readers and writers on temporary folders."""

import json

import pytest
from helpers import at, by, rows
from pyspark.sql import functions as F

from auditweave.operators import evaluate
from auditweave.sources import files, sinks


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def split(tmp_path):
    write(tmp_path / "aws_benign_cal.json", [{"eventID": "1", "x": None}, {"eventID": "2"}])
    write(tmp_path / "azure_benign_cal.json", [{"category": "c"}])
    write(tmp_path / "gcp_benign_cal.json", [{"insertId": "g", "nested": {"a": [1, 2]}}])


def test_split_reading(spark, tmp_path):
    split(tmp_path)
    got = files.read_split(spark, str(tmp_path), "benign").orderBy("cloud", "raw").collect()
    assert [(r["cloud"], json.loads(r["raw"])) for r in got] == [
        ("AWS", {"eventID": "1", "x": None}), ("AWS", {"eventID": "2"}), ("AZURE", {"category": "c"}),
        ("GCP", {"insertId": "g", "nested": {"a": [1, 2]}})]


def test_split_wants_exactly_one_file_per_cloud(spark, tmp_path):
    split(tmp_path)
    write(tmp_path / "aws_benign_two.json", [])
    with pytest.raises(FileNotFoundError):
        files.read_split(spark, str(tmp_path), "benign")
    with pytest.raises(FileNotFoundError):
        files.read_split(spark, str(tmp_path), "attack")


def test_json_lines_and_merge_order(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"eventTime":"2026-01-02T00:00:00Z"}\n\n{"time":"2026-01-01T00:00:00Z"}\n')
    write(tmp_path / "b.jsonl", '{"timestamp":"2026-01-01T12:00:00Z"}\n')
    a, b = (files.read_json_lines(spark, str(tmp_path / n)) for n in ("a.jsonl", "b.jsonl"))
    assert [r["event_time"][:13] for r in files.merge_sources(a, b).collect()] == ["2026-01-01T00", "2026-01-01T12", "2026-01-02T00"]


def test_labels_and_lists(spark, tmp_path):
    names = [f.split()[0] for f in files.LABEL_SCHEMA.split(", ")]
    write(tmp_path / "labels.csv", ",".join(names) + "\ne1,apt,ann,AWS,Get,2026-01-01T00:00:00Z,True,Impact,4.0,t,T1,n,i,x,train,\n")
    row = files.read_labels(spark, str(tmp_path / "labels.csv")).first()
    assert (row["event_id"], row["anomaly_flag"], row["severity_score"], row["created"]) == ("e1", True, 4.0, None)
    write(tmp_path / "tor.txt", "# list\n\n 1.2.3.4 \n5.6.7.8\n")
    assert sorted(r[0] for r in files.read_ip_list(spark, str(tmp_path / "tor.txt")).collect()) == ["1.2.3.4", "5.6.7.8"]
    assert files.read_ip_list(spark, str(tmp_path / "none.txt")) is None
    write(tmp_path / "r.csv", "start_ip,end_ip,country,asn_org\n1.0.0.0,1.0.0.255,AU,X\n")
    assert files.read_ip_ranges(spark, str(tmp_path / "r.csv")).count() == 1


def test_upsert_keeps_the_newest_and_repeats_safely(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "entity_id string, seq int, v string"
    assert sinks.read_latest(spark, path, "entity_id", ["seq"]) is None
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema)
    second = spark.createDataFrame([("a", 3, "w"), ("c", 1, "n")], schema)
    for batch, frame in ((0, first), (1, second), (1, second)):
        sinks.upsert_latest(frame, "entity_id", ["seq"], path, batch)
    got = {r["entity_id"]: r["v"] for r in sinks.read_latest(spark, path, "entity_id", ["seq"]).collect()}
    assert got == {"a": "w", "b": "z", "c": "n"}
    sinks.compact_latest(spark, path, "entity_id", ["seq"], str(tmp_path / "c"))
    assert {r["entity_id"]: r["v"] for r in sinks.read_latest(spark, str(tmp_path / "c"), "entity_id", ["seq"]).collect()} == got


def test_event_dead_letter_and_alert_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("e", at(0), "AWS", 0.5)], "event_id string, timestamp timestamp, source_cloud string, anomaly_score double")
    sinks.write_events(frame, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).where("event_date = '2026-06-04' and source_cloud = 'AWS'").count() == 1
    sinks.export_scored(frame, str(tmp_path / "sc"))
    sinks.export_json(frame, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 1
    sinks.write_dead_letters(spark.createDataFrame([("bad", "{}")], "error string, raw_log string"), str(tmp_path / "dead"))
    assert rows(spark.read.json(str(tmp_path / "dead")))[0]["error"] == "bad"
    alerts = frame.withColumns({
        "entity_id": F.lit("x"), "principal": F.lit("p"), "action": F.lit("a"), "predicted_phase": F.lit("Impact"),
        "scaled_score": F.lit(0.9), "dominant_signal": F.lit("d"), "narrative": F.lit("n"), "passed_gate": F.lit(True)})
    sinks.write_alert_lines(alerts, str(tmp_path / "lines"), F.lit("hello"))
    back = sinks.read_alert_lines(spark, str(tmp_path / "lines")).first()
    assert (back["cloud"], back["phase"]) == ("AWS", "Impact") and ":: hello ::" in back["line"]
    for passed in (True, False):
        sinks.append_ledger(alerts.withColumn("passed_gate", F.lit(passed)), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def test_curve_export_and_top(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.2, 0), ("b", 0.8, 1), ("c", 0.8, 1)], "event_id string, anomaly_score double, y int")
    sinks.export_curve(evaluate.pr_curve(frame, "anomaly_score", "y"), str(tmp_path / "curve"))
    assert spark.read.option("header", True).csv(str(tmp_path / "curve")).count() == 2
    assert list(by(sinks.top_scored(frame, 2))) == ["b", "c"]
