"""Risk formula cases, window boundaries and parameter checks."""

import random

import pytest
from helpers import at, by, rows
from pyspark.sql import functions as F

from auditweave.operators import risk

SCHEMA = (
    "event_id int, timestamp timestamp, entity_id string, principal string, source_cloud string, "
    "principal_type string, ua_family string, anomaly_score double, phase_confidence double"
)


def event(i, s, cloud="AWS", anomaly=0.9, kind="IAMUser", ua="Chrome", entity="e", conf=None):
    return (i, at(s), entity, "p", cloud, kind, ua, anomaly, conf)


def run(spark, data, **kw):
    return by(risk.score(spark.createDataFrame(data, SCHEMA), **kw))


def test_single_event(spark):
    r = run(spark, [event(0, 0)])[0]
    assert (r["risk_intensity"], r["scaled_score"], r["diversity_multiplier"]) == (0.95, 0.4872, 1.0)
    assert r["trust_score"] == pytest.approx(51.28) and not r["is_critical"]


def test_three_clouds_with_and_without_baseline(spark):
    data = [event(0, 0, "AWS", 0.0), event(1, 100, "AZURE", 0.0), event(2, 200, "GCP", 0.9)]
    r = run(spark, data)[2]
    assert (r["diversity_multiplier"], r["risk_intensity"], r["scaled_score"], r["is_critical"]) == (9.0, 8.15, 0.8907, True)
    normal = spark.createDataFrame([("e", ["AWS", "AZURE", "GCP"])], "entity_id string, clouds array<string>")
    r = run(spark, data, baselines=normal)[2]
    assert (r["diversity_multiplier"], r["novel_cloud_span_count"], r["baseline_cloud_span_count"]) == (1.0, 0, 3)


def test_window_and_lifetime(spark):
    r = run(spark, [event(0, 0, "AWS", ua="curl"), event(1, 120, "GCP", ua="curl")])[1]
    assert (r["window_events"], r["cloud_span_count"], r["novel_cloud_span_count"]) == (1, 2, 1)
    assert r["diversity_multiplier"] == 1.7


def test_closed_window_and_ties(spark):
    data = [event(0, 0), event(1, 60), event(2, 60), event(3, 120.000001)]
    got = run(spark, data)
    assert [got[i]["window_events"] for i in range(4)] == [1, 2, 3, 1]
    weight = 0.5 ** (60 / 1800)
    assert got[1]["risk_intensity"] == pytest.approx(0.05 + 0.9 + 0.9 * weight, abs=1e-6)


def test_anomaly_fallbacks(spark):
    data = [event(0, 0, anomaly=None, conf=0.4), event(1, 1000, anomaly=None), event(2, 2000, anomaly=float("nan")),
            event(3, 3000, anomaly=7.0), event(4, 4000, anomaly=-1.0)]
    got = run(spark, data)
    assert [got[i]["risk_intensity"] for i in range(5)] == [0.45, 0.15, 0.15, 1.05, 0.05]
    assert got[4]["dominant_signal"] == "baseline_only"


def test_unknown_and_entra_clouds(spark):
    got = run(spark, [event(0, 0, "Entra-ID"), event(1, 1, "azure"), event(2, 2, None)])
    assert got[2]["active_clouds"] == ["AZURE"] and got[2]["cloud_span_count"] == 1


def test_class_from_window_breaks_ties_by_first(spark):
    data = [event(0, 0, kind="AssumedRole"), event(1, 1, kind="IAMUser"), event(2, 2, kind="IAMUser"), event(3, 63, kind="AssumedRole")]
    got = run(spark, data, class_from="window")
    assert [got[i]["principal_class"] for i in range(4)] == ["automation", "automation", "human", "automation"]


def test_random_decay_against_brute_force(spark):
    random.seed(3)
    data = [event(i, random.randrange(0, 2000) / 4, anomaly=random.random(), entity=random.choice("ab")) for i in range(200)]
    params = risk.RiskParams(half_life_seconds=20.0, window_seconds=30.0)
    for skew in ({}, {"hot_rows": 10, "slice_us": 50_000_000}):
        got = run(spark, data, params=params, **skew)
        for e in data:
            active = [o for o in data if o[2] == e[2] and (o[1], o[0]) <= (e[1], e[0]) and (e[1] - o[1]).total_seconds() <= 30]
            total = sum(o[7] * 0.5 ** ((e[1] - o[1]).total_seconds() / 20) for o in active)
            assert got[e[0]]["decayed_sum"] == pytest.approx(total, rel=1e-12)


def test_contributions_and_struct(spark):
    frame = spark.createDataFrame([event(0, 0), event(1, 30), event(2, 200)], SCHEMA)
    assert [r["event_id"] for r in rows(risk.contributions(frame))] == [2]
    packed = rows(risk.as_struct(risk.score(frame)))[0]["risk"]
    assert set(packed) == set(risk.RESULT_FIELDS)


def test_contributions_by_hand(spark):
    data = [event(0, 0), event(1, 1, "aws", 0.8), event(2, 31, "Entra-ID", None, conf=0.4), event(3, 61, None, float("nan")),
            event(4, 0, "GCP", 7.0, entity="f"), event(5, 0, "GCP", -1.0, entity="f")]
    got = by(risk.contributions(spark.createDataFrame(data, SCHEMA), risk.RiskParams(half_life_seconds=30.0)))
    columns = ("entity_id", "principal", "source_cloud", "anomaly_score", "age_seconds", "weight", "contribution")
    assert {i: tuple(r[c] for c in columns) for i, r in got.items()} == {
        1: ("e", "p", "AWS", 0.8, 60.0, 0.25, 0.2),
        2: ("e", "p", "AZURE", 0.4, 30.0, 0.5, 0.2),
        3: ("e", "p", "UNKNOWN", 0.1, 0.0, 1.0, 0.1),
        4: ("f", "p", "GCP", 1.0, 0.0, 1.0, 1.0),
        5: ("f", "p", "GCP", 0.0, 0.0, 1.0, 0.0),
    }


def test_isolated_equals_one_event_entities(spark):
    data = [event(i, i, anomaly=i / 10, entity=f"e{i}", kind=k) for i, k in enumerate(["IAMUser", "Role", None])]
    frame = spark.createDataFrame(data, SCHEMA)
    a, b = by(risk.isolated(frame)), by(risk.score(frame))
    for i in a:
        assert all(a[i][c] == b[i][c] for c in risk.RESULT_FIELDS)


def test_recalibration(spark):
    frame = spark.range(100).select((F.col("id") / 10.0).alias("risk_intensity"))
    scaled = sorted(i / 10 / (i / 10 + 1) for i in range(100))
    for p in (95, 99, 100, 50):
        got = risk.nearest_rank_threshold(frame, percentile=p).first()["threshold"]
        assert got == round(min(0.999, scaled[min(int(100 * p / 100), 99)]), 4)
    assert risk.approximate_threshold(frame).first()["threshold"] == pytest.approx(0.9038, abs=0.01)
    with pytest.raises(ValueError):
        risk.nearest_rank_threshold(frame, percentile=0)


@pytest.mark.parametrize("bad", [
    {"half_life_seconds": 0}, {"per_cloud_multiplier": 0.5}, {"automation_cloud_multiplier": 4.0}, {"baseline": -1},
])
def test_parameter_checks(bad):
    with pytest.raises(ValueError):
        risk.RiskParams(**bad)


def test_window_class_counts_unlisted_types(spark):
    kinds = ["Role", "Foo", "Bar", "Foo", "Role", "Bar", "Role"]
    got = run(spark, [event(i, i, kind=k) for i, k in enumerate(kinds)], class_from="window")
    assert got[6]["principal_class"] == "automation"
    # ties at equal times go by the order of events: Zed came first, so it decides
    got = run(spark, [event(0, 0, kind="Zed"), event(1, 0, kind="Role")], class_from="window")
    assert got[1]["principal_class"] == "human"
    got = run(spark, [event(0, 0, kind=None), event(1, 100, kind="")], class_from="window")
    assert [got[i]["principal_class"] for i in (0, 1)] == ["human", "human"]


def crowd(seed, n=600):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        entity = "hot" if rng.random() < 0.8 else f"e{rng.randrange(4)}"
        data.append(event(i, round(rng.random() * 130, 1), rng.choice(["AWS", "AZURE", "GCP", None]), rng.random(),
                          kind=rng.choice([f"T{rng.randrange(300)}", "IAMUser", "Role", None, ""]), ua=rng.choice(["Chrome", "curl"]), entity=entity))
    return data


def test_crowded_windows_in_parts_change_nothing(spark):
    data = crowd(1)
    plain, split = run(spark, data), run(spark, data, hot_rows=20, slice_us=7_000_000)
    assert len(plain) == len(split) == len(data)
    for i, row in plain.items():
        for name in ("risk_intensity", "scaled_score", "window_events", "window_cloud_span_count", "cloud_span_count", "principal_class"):
            assert split[i][name] == pytest.approx(row[name]) if isinstance(row[name], float) else split[i][name] == row[name]
    frame = spark.createDataFrame(data, SCHEMA)
    a, b = by(risk.active_window(frame, hot_rows=None)), by(risk.active_window(frame, hot_rows=20))
    assert {i: (r["active_events"], r["window_start"]) for i, r in a.items()} == {i: (r["active_events"], r["window_start"]) for i, r in b.items()}


def test_one_entity_in_one_minute_is_many_tasks(spark):
    frame = spark.range(20_000).select(
        F.col("id").cast("int").alias("event_id"), F.timestamp_micros(F.lit(1_780_000_000_000_000) + F.col("id") * 2_900).alias("timestamp"),
        F.lit("hot").alias("entity_id"))
    out = risk.active_window(frame, hot_rows=1_000)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) >= 8 and max(sizes) < 8_000
        assert out.where(F.col("active_events") != F.least(F.col("event_id") + 1, F.lit(20_690))).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_class_from_window_equals_brute_force_for_many_types(spark):
    for seed, hot_rows in ((2, 2_000_000), (3, 25)):
        data = crowd(seed)
        got = run(spark, data, class_from="window", hot_rows=hot_rows)
        from auditweave.functions.agents import RISK_AUTOMATION_TYPES, RISK_AUTOMATION_HINTS

        for e in data:
            window = [o for o in data if o[2] == e[2] and (o[1], o[0]) <= (e[1], e[0]) and (e[1] - o[1]).total_seconds() <= 60]
            first, counts = {}, {}
            for o in sorted(window, key=lambda o: (o[1], o[0])):
                if o[5]:
                    kind = o[5].upper()
                    counts[kind] = counts.get(kind, 0) + 1
                    first.setdefault(kind, (o[1], o[0]))
            deciding = min(counts, key=lambda k: (-counts[k], first[k])) if counts else None
            hinted = any(h in o[6].lower() for o in window for h in RISK_AUTOMATION_HINTS)
            assert got[e[0]]["principal_class"] == ("automation" if deciding in RISK_AUTOMATION_TYPES or hinted else "human"), e


def test_thousands_of_types(spark):
    data = [event(i, i * 0.01, kind=f"type{i}") for i in range(5_000)] + [event(9_000, 49.9, kind="Role"), event(9_001, 49.95, kind="Role")]
    got = run(spark, data, class_from="window")
    assert got[9_001]["principal_class"] == "automation" and got[4_989]["principal_class"] == "human" and len(got) == 5_002
