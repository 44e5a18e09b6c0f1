"""Streams must give what the batch operators give."""

import json

from helpers import at, by
from pyspark.sql import functions as F

from auditweave.operators import features, identity, risk
from auditweave.plans.adapter import audit_events
from auditweave.sources import sinks
from auditweave.streaming import flows
from test_features import SCHEMA, sequence
from test_identity import SCHEMA as ID_SCHEMA
from test_identity import compare, random_events, replay
from test_normalize import AWS, GCP


def parts(frame, path, n, order="timestamp"):
    """Write a table as n files whose names follow time order."""
    data = frame.orderBy(order, "event_id").collect()
    size = -(-len(data) // n)
    for i in range(n):
        piece = frame.sparkSession.createDataFrame(data[i * size:(i + 1) * size], frame.schema)
        piece.coalesce(1).write.mode("append").parquet(path)
    return path


def test_raw_ingest_with_dead_letters(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in (AWS, GCP, {"x": 1})))
    stream = flows.raw_stream(spark, str(source))
    query = flows.write_normalized(stream, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a1", "g1"]
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


def run_to_table(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return stream.sparkSession.table(name)


def feature_parity(spark, frame, tmp_path, name, n):
    path = parts(frame, str(tmp_path / "src"), n)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = by(run_to_table(flows.stream_features(stream), name, tmp_path))
    want = by(features.features(frame))
    assert len(got) == len(want)
    for i, row in want.items():
        for c in ("is_new_ip_for_user", "is_new_device_for_user", "api_call_count_1m", "error_rate_5m", "read_vs_write_ratio",
                  "unique_resources_accessed", "unique_ips_last_24h", "privileged_actions_last_24h"):
            assert abs(got[str(i)][c] - row[c]) < 1e-12, (i, c)


def test_feature_stream_equals_batch(spark, tmp_path):
    feature_parity(spark, sequence(spark), tmp_path, "ten", 4)


def test_feature_stream_equals_batch_on_the_events(spark, sf_dir, tmp_path):
    ev = audit_events(spark, sf_dir).select("event_id", "timestamp", "user_id", "action", "status", "source_ip",
                                            "resource", "source_cloud", "user_agent")
    feature_parity(spark, ev, tmp_path, "events_features", 3)


def test_busy_user_keeps_a_whole_day(spark, tmp_path):
    data = [(i, at(2 * i), "u", "GetX", "SUCCESS", f"1.1.{i // 200}.{i % 200}", f"r{i}", "AWS") for i in range(5_000)]
    frame = spark.createDataFrame(data, SCHEMA)
    path = parts(frame, str(tmp_path / "src"), 2)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    got = by(run_to_table(flows.stream_features(stream), "busy", tmp_path))
    assert [got[str(i)]["api_call_count_1m"] for i in range(5_000)] == [min(i + 1, 30) for i in range(5_000)]
    assert [got[str(i)]["unique_ips_last_24h"] for i in range(5_000)] == list(range(1, 5_001))


def test_idle_users_expire(spark, tmp_path):
    path = parts(sequence(spark), str(tmp_path / "src"), 2)
    stream = spark.readStream.schema(sequence(spark).schema).parquet(path)
    query = flows.stream_features(stream, ttl_hours=48.0).writeStream.format("memory").queryName("ttl").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("ttl").count() == 10:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert spark.table("ttl").count() == 10


def test_sliding_alerts_and_sessions(spark, tmp_path):
    frame = spark.createDataFrame(
        [(i, at(s), True, "apt", "ann") for i, s in enumerate([0, 30, 200, 90_000, 200_000])],
        "event_id int, timestamp timestamp, is_critical boolean, scenario string, actor string")
    path = parts(frame, str(tmp_path / "src"), 3)
    def stream():
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    alerts = run_to_table(flows.alert_increase(stream()), "alerts", tmp_path).collect()
    counts = {r["window_start"].isoformat(): r["alerts"] for r in alerts}
    assert counts["2026-06-04T09:00:00"] == 3 and counts["2026-06-04T08:56:00"] == 2
    sessions = run_to_table(flows.campaign_sessions(stream()), "sessions", tmp_path).collect()
    assert sorted(r["n_steps"] for r in sessions)[-1] == 3


def test_identity_stream_equals_one_batch(spark, tmp_path):
    data = sorted(random_events(41, n=200, people=60, fed=0.04, made=0.1), key=lambda e: (e[1], e[0]))
    frame = spark.createDataFrame(data, ID_SCHEMA).withColumn("anomaly_score", F.lit(0.5))
    path = parts(frame, str(tmp_path / "src"), 3)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    job = flows.IdentityStream(str(tmp_path / "out"))
    job.start(stream, str(tmp_path / "cp")).awaitTermination(280)
    done = spark.read.parquet(str(tmp_path / "out/scored")).drop("batch_id")
    compare(identity.Resolution(done, None), replay(data))
    whole = risk.score(identity.resolve_entities(frame).events)
    a, b = by(done), by(whole)
    assert len(a) == len(b) == len(data)
    for i in a:
        assert (a[i]["risk_intensity"], a[i]["active_clouds"], a[i]["window_events"]) == (
            b[i]["risk_intensity"], b[i]["active_clouds"], b[i]["window_events"])
    latest = sinks.read_latest(spark, str(tmp_path / "out/risk_state"), "entity_id", ["timestamp", "event_id"])
    assert latest.count() == done.select("entity_id").distinct().count()


def test_late_rows_are_split_off(spark):
    frame = spark.createDataFrame([(1, at(0)), (2, at(10))], "event_id int, timestamp timestamp")
    on_time, late = flows.split_late(frame, int(at(5).timestamp() * 1_000_000))
    assert [r[0] for r in on_time.collect()] == [2] and [r[0] for r in late.collect()] == [1]
