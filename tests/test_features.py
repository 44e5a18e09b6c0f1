"""Trailing windows: boundaries, ties, nulls, and slices that must not change a result."""

import random

import pytest
from helpers import at, by, rows
from pyspark.sql import functions as F

from auditweave import session
from auditweave.operators import features, ordered
from auditweave.plans.adapter import audit_events

SEQUENCE = [
    (0, "ConsoleLogin", "SUCCESS", 10, 1, 0.0, 1), (20, "ConsoleLogin", "FAILURE", 10, 2, 1 / 2, 1),
    (40, "ConsoleLogin", "FAILURE", 11, 3, 2 / 3, 2), (70, "ListUsers", "SUCCESS", 11, 3, 2 / 4, 2),
    (300, "GetUser", "SUCCESS", 12, 1, 2 / 4, 3), (600, "CreateUser", "SUCCESS", 12, 1, 0.0, 3),
    (900, "AttachUserPolicy", "SUCCESS", 13, 1, 0.0, 4), (1500, "AssumeRole", "SUCCESS", 14, 1, 0.0, 5),
    (3600, "ListRoles", "SUCCESS", 15, 1, 0.0, 6), (7200, "DescribeInstances", "SUCCESS", 16, 1, 0.0, 7),
]
SCHEMA = "event_id int, timestamp timestamp, user_id string, action string, status string, source_ip string, resource string, source_cloud string"


def sequence(spark):
    data = [(i, at(s), "u", a, st, f"203.0.113.{ip}", f"res-{a}", "AWS") for i, (s, a, st, ip, *_) in enumerate(SEQUENCE)]
    return spark.createDataFrame(data, SCHEMA)


def test_ten_event_sequence(spark):
    got = by(features.features(sequence(spark)))
    for i, (*_, calls, errors, ips) in enumerate(SEQUENCE):
        assert got[i]["api_call_count_1m"] == calls
        assert got[i]["error_rate_5m"] == pytest.approx(errors)
        assert got[i]["unique_ips_last_24h"] == ips
    assert got[5]["privileged_actions_last_24h"] == 1
    assert [got[i]["is_new_ip_for_user"] for i in range(5)] == [1, 0, 1, 0, 1]
    assert got[0]["hour_of_day"] == 9 and got[0]["day_of_week"] == 3


def test_ties_and_nulls(spark):
    data = [(0, at(0), "u", "GetX", "SUCCESS", None, "r", "AWS"), (1, at(0), "u", "PutX", "FAILED", None, None, "AWS"),
            (2, at(60), "u", "PutX", "FAILED", "1.1.1.1", None, "AWS"), (3, at(60), "v", "PutX", "SUCCESS", None, "r", "AWS")]
    got = by(features.features(spark.createDataFrame(data, SCHEMA)))
    assert [got[i]["api_call_count_1m"] for i in range(4)] == [2, 2, 1, 1]
    assert [got[i]["unique_ips_last_24h"] for i in range(4)] == [1, 1, 2, 1]
    assert [got[i]["unique_resources_accessed"] for i in range(3)] == [2, 2, 2]
    assert [got[i]["is_new_ip_for_user"] for i in range(4)] == [1, 0, 1, 1]
    assert got[0]["is_internal_ip"] == -1


def test_columns_and_target_isolation(spark):
    assert (len(features.feature_columns()), len(features.feature_columns(True))) == (24, 28)
    frame = features.features(sequence(spark).withColumn("severity", F.lit("HIGH")))
    x, y = features.split_features(frame, labeled=True)
    assert not set(x.columns) & set(features.TARGETS)
    assert {r["severity"] for r in y.collect()} == {3}


def test_encoder_codes_are_alphabetical_with_an_unknown_slot(spark):
    frame = features.features(sequence(spark))
    model = features.fit_encoder(frame)
    codes = {r["action"]: r["action__code"] for r in features.encode(model, frame).collect()}
    assert [codes[a] for a in sorted(codes)] == [float(i) for i in range(len(codes))]
    odd = features.encode(model, frame.withColumn("action", F.lit("NeverSeen")))
    assert {r["action__code"] for r in odd.collect()} == {float(len(codes))}


def test_hot_users_give_the_same_features(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    plain = features.features(ev)
    names = [*features.feature_columns(True), "is_new_ip_for_user", "event_id"]
    for hot, width in ((1, 3_600_000_000), (20, 86_400_000_000 // 2)):
        sliced = features.features(ev, hot_rows=hot, slice_us=width)
        assert plain.select(names).exceptAll(sliced.select(names)).isEmpty()
        assert plain.count() == sliced.count()


def brute(values, seconds):
    out = {}
    for i, (t, user, v) in enumerate(values):
        window = [(x, w) for (x, u, w) in values if u == user and t - seconds * 1_000_000 < x <= t]
        out[i] = (sum(w or 0 for _, w in window), len({w for _, w in window}))
    return out


def test_trailing_against_brute_force(spark):
    random.seed(5)
    values = [(random.randrange(0, 400) * 1_000_000, random.choice("aab"), random.choice([1, 2, 3, None])) for _ in range(120)]
    frame = spark.createDataFrame([(i, t, u, v) for i, (t, u, v) in enumerate(values)], "i int, t long, u string, v int")
    for hot, width in ((None, 1), (5, 10_000_000), (5, 7_000_000)):
        sliced = ordered.with_slices(frame, ["u"], "t", hot, width)
        out = ordered.trailing(
            sliced, "t", ["i"],
            {"s": ordered.TrailingSum(50, F.coalesce(F.col("v"), F.lit(0)))}, {"d": ordered.TrailingDistinct(50, "v")},
        )
        assert {r["i"]: (r["s"], r["d"]) for r in out.collect()} == brute(values, 50)


def test_running_folds_survive_slicing(spark):
    random.seed(7)
    data = [(i, i * 1_000_000, random.choice(["a", "a", "b", None]), random.choice(["x", "y", None])) for i in range(60)]
    frame = spark.createDataFrame(data, "i int, t long, u string, v string")
    folds = {"n": ordered.total(F.lit(1)), "last": ordered.latest(F.col("v")), "set": ordered.members(F.col("v")),
             "low": ordered.lowest(F.col("i")), "high": ordered.highest(F.col("i"))}
    def result(hot, width):
        out = ordered.running(ordered.with_slices(frame, ["u"], "t", hot, width), "t", ["i"], folds).plain()
        return sorted(out.withColumn("set", F.array_sort("set")).collect())
    assert result(None, 1) == result(3, 4_000_000) == result(3, 11_000_000)


def test_global_prefix_matches_a_plain_window(spark):
    frame = spark.range(500).select((F.col("id") * 7 % 501).cast("double").alias("x"), F.lit(1).alias("n"))
    for limit in (10, 100_000):
        out = ordered.global_prefix(frame, "x", {"upto": "n"}, descending=True, buckets=13, small_rows=limit)
        got = {r["x"]: r["upto"] for r in out.collect()}
        assert [got[x] for x in sorted(got, reverse=True)] == list(range(1, 501))


def test_exact_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, None], [2.0, 2.0, 7.0], list(map(float, range(101)))):
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        kept = sorted(v for v in values if v is not None)
        middle = (kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2
        assert ordered.exact_median(frame, "x").first()[0] == middle
    assert ordered.exact_median(spark.createDataFrame([], "x double"), "x").first()[0] is None


def test_sessionize_strict_gap_and_slices(spark):
    seconds = [0, 10, 20, 30.000001, 40, 41, 100]
    data = [(i, "k", int(s * 1_000_000)) for i, s in enumerate(seconds)]
    frame = spark.createDataFrame(data, "i int, k string, t long")
    for hot, width in ((None, 1), (2, 15_000_000)):
        out = by(ordered.sessionize(frame, ["k"], "t", ["i"], 10_000_000, hot_rows=hot, slice_us=width), "i")
        assert [out[i]["session_no"] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2]


def test_export(spark, tmp_path):
    features.export_features(features.features(sequence(spark).withColumn("severity", F.lit("LOW"))),
                             str(tmp_path / "x"), str(tmp_path / "y"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 10
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "y")))[0]["severity"] == "1"


def test_tasks_of_a_large_table_keep_their_size(spark, monkeypatch):
    frame = spark.range(900).selectExpr("id AS event_id", "concat('u', id % 40) AS user_id", "id * 1000000 AS at", "id % 7 AS v")
    def marked():
        return ordered.mark_first(ordered.with_slices(frame, ["user_id"], "at"), "at", ["event_id"], {"new": ["v"]}).df
    small = {r["event_id"]: r["new"] for r in marked().collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 30)
    assert marked().rdd.getNumPartitions() == 30
    assert {r["event_id"]: r["new"] for r in marked().collect()} == small
    assert session.spread(frame).rdd.getNumPartitions() == 30
