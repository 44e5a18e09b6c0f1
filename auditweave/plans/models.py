"""Queries over the models and their explanations.

Forests and attributions have no SQL counterpart; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.operators import boosting, classifier, explain, features, iforest, monitor
from auditweave.plans.adapter import EV, audit_events
from auditweave.plans.behaviour import matrix_sql
from auditweave.plans.registry import query
from auditweave.session import cut_lineage, spread

NUMERIC = [c for c in features.BASE_FEATURES if c not in features.CATEGORICAL]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(cut_lineage(features.features(audit_events(spark, sf_dir))))


@query("iforest_scores")
def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on benign rows, applied to all."""
    table = feature_table(spark, sf_dir)
    model = iforest.fit(table.where(F.col("is_attack") == 0), NUMERIC, trees=100)
    return iforest.score(table, model).select("event_id", "is_attack", "if_anomaly_score")


@query(
    "balanced_class_weights",
    f"""WITH {EV}, c AS (SELECT threat_category, count(*) AS n FROM ev GROUP BY 1)
    SELECT threat_category, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def balanced_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = classifier.balanced_weights(audit_events(spark, sf_dir), "threat_category")
    return weighted.groupBy("threat_category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight")
    )


@query(
    "unseen_classes_dropped",
    f"""WITH {EV} SELECT event_id, action FROM ev WHERE home_cloud <> 'GCP'
    AND action IN (SELECT action FROM ev WHERE value > 300)""",
)
def unseen_classes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    test = ev.where(F.col("home_cloud") != "GCP").select("event_id", "action")
    return classifier.drop_unseen_classes(test, ev.where(F.col("value") > 300), "action")


@query(
    "bypass_scores",
    f"""WITH {EV} SELECT event_id, CAST(0.1 AS DOUBLE) AS anomaly_score, CAST(0.1 AS DOUBLE) AS if_anomaly_score,
    'Normal' AS predicted_phase, 0 AS predicted_phase_index, CAST(0.1 AS DOUBLE) AS phase_confidence FROM ev""",
)
def bypass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_phase(audit_events(spark, sf_dir), None).select(
        "event_id", "anomaly_score", "if_anomaly_score", "predicted_phase",
        "predicted_phase_index", "phase_confidence",
    )


def _phase_model(table: DataFrame) -> classifier.PhaseModel:
    first_half = table.where(F.col("timestamp") < F.lit("2024-01-15").cast("timestamp"))
    return classifier.fit_phase(first_half, trees=20, depth=5)


@query("phase_scores")
def phase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_table(spark, sf_dir)
    return classifier.score_phase(
        table.drop("anomaly_score", "predicted_phase", "phase_confidence"), _phase_model(table)
    ).select(
        "event_id", "threat_category", "predicted_phase", "predicted_phase_index",
        "phase_confidence", "anomaly_score",
    )


@query("leave_one_scenario_out")
def leave_one_scenario_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home clouds as scenarios; the first benign half is training noise."""
    table = feature_table(spark, sf_dir).drop("anomaly_score", "predicted_phase", "phase_confidence")
    early = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    attack = F.col("is_attack") == 1
    attacks = table.where(attack | early).withColumn(
        "scenario", F.when(attack, F.col("home_cloud")).otherwise("benign_noise")
    )
    return classifier.leave_one_group_out(attacks, table.where(~attack & ~early), trees=10, depth=4)


@query("boosted_phase_scores")
def boosted_phase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``phase_scores``, by boosted trees."""
    table = feature_table(spark, sf_dir).drop("anomaly_score", "predicted_phase", "phase_confidence")
    first_half = table.where(F.col("timestamp") < F.lit("2024-01-15").cast("timestamp"))
    model = classifier.fit_phase(first_half, algorithm="boosted", trees=4, depth=3)
    return classifier.score_phase(table, model).select(
        "event_id", "threat_category", "predicted_phase", "predicted_phase_index",
        "phase_confidence", "anomaly_score",
    )


# One round of one split per class on five whole-number columns: small enough for SQL to search every
# split and to attribute every score.
_WHOLE = {
    "hour": ("hour(timestamp)", "hour(ts)"),
    "weekday": ("weekday(timestamp)", "isodow(ts) - 1"),
    "k": ("k", "k"),
    "amount": ("floor(value / 10)", "floor(value / 10)"),
    "person": ("user_no % 31", "user_id % 31"),
}
_ROOTS = f"""WITH {EV}, c AS (SELECT threat_category, row_number() OVER (ORDER BY threat_category) - 1 AS y, n,
    sum(n) OVER () / (count(*) OVER () * n) AS w, count(*) OVER () AS classes FROM (
      SELECT threat_category, count(*) AS n FROM ev GROUP BY 1)),
  rows AS (SELECT event_id, y, w, 1e0 / classes AS p, classes, unnest([{', '.join(f"struct_pack(f := {i}, v := CAST({sql} AS DOUBLE))" for i, (_, sql) in enumerate(_WHOLE.values()))}],
    recursive := true) FROM ev JOIN c USING (threat_category)),
  cells AS (SELECT o.y AS class, f, v, sum(rows.w * (p - CASE WHEN rows.y = o.y THEN 1 ELSE 0 END)) AS g, sum(rows.w * p * (1 - p)) AS h
    FROM rows CROSS JOIN (SELECT y FROM c) o GROUP BY 1, 2, 3),
  cuts AS (SELECT *, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(g) OVER cell AS gt, sum(h) OVER cell AS ht, max(v) OVER cell AS top
    FROM cells WINDOW cell AS (PARTITION BY class, f), up AS (PARTITION BY class, f ORDER BY v)),
  gains AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM cuts
    WHERE v < top AND hl >= 1 AND ht - hl >= 1),
  stumps AS (SELECT class, f, v, gain, -0.3 * gl / (hl + 1) AS low, -0.3 * (gt - gl) / (ht - hl + 1) AS high, hl / ht AS share FROM gains
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(gain, 6) DESC, f, v) = 1)"""


def _whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).selectExpr(
        "event_id", "threat_category", *[f"CAST({sql} AS DOUBLE) AS {name}" for name, (sql, _) in _WHOLE.items()]
    )
    indexed = StringIndexer(inputCol="threat_category", outputCol="label", stringOrderType="alphabetAsc").fit(ev).transform(ev)
    weighted = classifier.balanced_weights(indexed, "threat_category")
    return cut_lineage(VectorAssembler(inputCols=list(_WHOLE), outputCol="features").transform(weighted))


def _classes(table: DataFrame) -> int:
    return table.select("label").distinct().count()


@query("boosted_root_gains", f"{_ROOTS} SELECT class, f AS feature, round(max(gain), 4) AS gain FROM gains GROUP BY 1, 2")
def boosted_root_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best gain of each column for the first split of each class."""
    table = _whole_numbers(spark, sf_dir)
    gains = boosting.root_gains(table, "label", classes=_classes(table), weight="weight", bins=128)
    return gains.select(F.col("class").cast("long").alias("class"), F.col("feature").cast("long").alias("feature"), F.round("gain", 4).alias("gain"))


@query(
    "boosted_stumps",
    f"""{_ROOTS} SELECT class, f AS feature, v AS threshold, round(low, 5) AS low, round(high, 5) AS high FROM stumps""",
)
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of each class and the votes of its sides."""
    table = _whole_numbers(spark, sf_dir)
    model = boosting.fit(table, "label", classes=_classes(table), weight="weight", rounds=1, depth=1, bins=128)
    rows = [
        (c, int(model.feature[c, 1]), float(model.threshold[c, 1]), float(model.value[c, 2]), float(model.value[c, 3]))
        for c in range(model.classes)
    ]
    found = spark.createDataFrame(rows, "class long, feature long, threshold double, low double, high double")
    return found.withColumns({"low": F.round("low", 5), "high": F.round("high", 5)})


@query(
    "stump_attributions",
    f"""{_ROOTS}, a AS (SELECT event_id, class, stumps.f AS feature,
      CASE WHEN rows.v <= stumps.v THEN low ELSE high END - (share * low + (1 - share) * high) AS impact
      FROM rows JOIN stumps ON rows.f = stumps.f AND stumps.class = rows.event_id % rows.classes)
    SELECT event_id, class, feature, round(impact, 5) AS impact FROM a""",
)
def stump_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the split column adds to the margin of a class, for a class in turn per event."""
    table = _whole_numbers(spark, sf_dir)
    n = _classes(table)
    trees = boosting.fit(table, "label", classes=n, weight="weight", rounds=1, depth=1, bins=128)
    model = classifier.PhaseModel(None, trees, [str(c) for c in range(n)], list(_WHOLE))
    turns = table.withColumn("predicted_phase_index", (F.col("event_id") % n).cast("int"))
    impacts = explain.exact_shapley(turns, model).join(turns.select("event_id", F.col("predicted_phase_index").cast("long").alias("class")), "event_id")
    used = F.array(*[F.lit(int(f)).cast("long") for f in trees.feature[:, 1]])
    return impacts.withColumn("feature", F.get(used, F.col("class").cast("int"))).select(
        "event_id", "class", "feature", F.round(F.get("impacts", F.col("feature").cast("int")), 5).alias("impact")
    )


_VOTES = f"""{_ROOTS}, med AS (SELECT f, median(v) AS m FROM rows WHERE event_id IN (
      SELECT event_id FROM ev ORDER BY md5(event_id || ':42'), event_id LIMIT 100) GROUP BY f),
  votes AS (SELECT event_id, class, stumps.f, CASE WHEN rows.v <= stumps.v THEN low ELSE high END AS m,
      CASE WHEN med.m <= stumps.v THEN low ELSE high END AS without
    FROM rows JOIN stumps ON rows.f = stumps.f JOIN med ON med.f = stumps.f),
  probs AS (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY event_id) AS p FROM votes),
  best AS (SELECT * FROM probs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p DESC, class) = 1)"""
_GATE = f"""{_VOTES}, tries AS (SELECT event_id, class, round(p, 4) AS conf, 0 AS trial, f AS gone FROM best
    UNION ALL (SELECT event_id, class, round(p, 4), t.trial, o.f FROM best, (SELECT unnest([1, 2, 3]) AS trial) t,
      (SELECT unnest(range({len(_WHOLE)})) AS f) o WHERE o.f <> best.f
      QUALIFY row_number() OVER (PARTITION BY event_id, t.trial ORDER BY md5(concat_ws(':', event_id, t.trial, o.f, 1337)), o.f) = 1)),
  drops AS (SELECT t.event_id, any_value(t.class) AS class, t.trial, any_value(t.conf) - sum(CASE WHEN v.class = t.class
        THEN exp(CASE WHEN v.f = t.gone THEN without ELSE m END) ELSE 0 END)
      / sum(exp(CASE WHEN v.f = t.gone THEN without ELSE m END)) AS lost
    FROM tries t JOIN votes v ON v.event_id = t.event_id GROUP BY t.event_id, t.trial),
  gate AS (SELECT event_id, any_value(class) AS predicted_phase_index, max(lost) FILTER (WHERE trial = 0) AS attributed_drop,
      avg(lost) FILTER (WHERE trial > 0) AS control_drop FROM drops GROUP BY event_id),
  passed AS (SELECT *, attributed_drop >= 0.01 AND attributed_drop > control_drop AS passed_gate FROM gate)"""


def _stump_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, classifier.PhaseModel]:
    table = _whole_numbers(spark, sf_dir)
    names = [r[0] for r in table.select("threat_category").distinct().orderBy("threat_category").collect()]
    trees = boosting.fit(table, "label", classes=len(names), weight="weight", rounds=1, depth=1, bins=128)
    encoder = PipelineModel([VectorAssembler(inputCols=list(_WHOLE), outputCol="features")])
    background = cut_lineage(classifier.background_sample(table.select("event_id", "features")))
    return table.drop("features"), classifier.PhaseModel(encoder, trees, names, list(_WHOLE), background)


@query(
    "stump_phase_scores",
    f"""{_VOTES} SELECT b.event_id, c.threat_category AS predicted_phase, b.class AS predicted_phase_index,
      round(b.p, 4) AS phase_confidence, round(1 - n.p, 4) AS anomaly_score
    FROM best b JOIN c ON c.y = b.class JOIN probs n ON n.event_id = b.event_id
      JOIN c normal ON normal.y = n.class AND normal.threat_category = 'Normal'""",
)
def stump_phase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase, confidence and attack score under trees that SQL can fit as well."""
    table, model = _stump_model(spark, sf_dir)
    return classifier.score_phase(table, model).select(
        "event_id", "predicted_phase", "predicted_phase_index", "phase_confidence", "anomaly_score"
    )


def _stump_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = _stump_model(spark, sf_dir)
    alerts = cut_lineage(explain.attribute(classifier.score_phase(table, model), model, k=1))
    return explain.faithfulness(alerts, model, delta=0.01)


@query(
    "stump_faithfulness",
    f"""{_GATE} SELECT event_id, predicted_phase_index, round(attributed_drop, 5) AS attributed_drop,
      round(control_drop, 5) AS control_drop, passed_gate FROM passed""",
)
def stump_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deletion test with its seeded control sets."""
    return _stump_gate(spark, sf_dir).select(
        "event_id", "predicted_phase_index", F.round("attributed_drop", 5).alias("attributed_drop"),
        F.round("control_drop", 5).alias("control_drop"), "passed_gate",
    )


@query(
    "stump_routing",
    f"""{_GATE} SELECT event_id, CASE WHEN passed_gate THEN 'ledger' ELSE 'review' END AS target,
      CASE WHEN passed_gate THEN 'explained' ELSE '{explain.MANUAL_REVIEW}' END AS narrative FROM passed""",
)
def stump_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each alert goes after the gate."""
    ledger, review = explain.route(_stump_gate(spark, sf_dir), F.lit("explained"))
    return ledger.select("event_id", F.lit("ledger").alias("target"), "narrative").unionByName(
        review.select("event_id", F.lit("review").alias("target"), "narrative")
    )


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, classifier.PhaseModel]:
    table = feature_table(spark, sf_dir)
    model = _phase_model(table)
    scored = classifier.score_phase(
        table.drop("anomaly_score", "predicted_phase", "phase_confidence"), model
    )
    alerts = cut_lineage(scored.where(F.col("predicted_phase") != classifier.NORMAL))
    return cut_lineage(explain.attribute(alerts, model)), model


@query("alert_attributions")
def alert_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _ = _explained(spark, sf_dir)
    return alerts.select(
        "event_id", F.explode("attributions").alias("feature_name", "a")
    ).select("event_id", "feature_name", "a.raw_value", "a.impact")


@query("faithfulness_gate")
def faithfulness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, model = _explained(spark, sf_dir)
    return explain.faithfulness(alerts, model).select(
        "event_id", "predicted_phase", "attributed_drop", "control_drop", "passed_gate"
    )


@query("gate_routing")
def gate_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, model = _explained(spark, sf_dir)
    gated = explain.faithfulness(alerts, model).withColumns(
        {"dominant_signal": F.lit("model"), "active_clouds": F.array("source_cloud"),
         "scaled_score": F.col("anomaly_score")}
    )
    # cut: both sides of the routing read the gate's verdicts, which are computed once
    ledger, review = explain.route(cut_lineage(gated), monitor.alert_text())
    return ledger.select("event_id", "narrative", F.lit("ledger").alias("target")).unionByName(
        review.select("event_id", "narrative", F.lit("review").alias("target"))
    )


def _medians_sql() -> str:
    columns = features.feature_columns(True)
    codes = ", ".join(
        f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" if c in features.CATEGORICAL else c for c in columns
    )
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(CAST(median({c}) AS DOUBLE), 4) AS median FROM s" for c in columns
    )
    return (
        f"WITH m AS ({matrix_sql(labeled=True)}), e AS (SELECT event_id, {codes} FROM m), "
        f"s AS (SELECT * FROM e ORDER BY md5(event_id || ':42'), event_id LIMIT 100) {parts}"
    )


@query("background_medians", _medians_sql())
def background_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of every encoded feature over the background rows."""
    table = feature_table(spark, sf_dir)
    encoder = features.fit_encoder(table, labeled=True)
    encoded = features.encode(encoder, table).select("event_id", "features")
    medians = classifier.background_medians(classifier.background_sample(encoded))
    return spark.createDataFrame(
        list(zip(features.feature_columns(True), medians, strict=True)), "feature string, median double"
    ).withColumn("median", F.round("median", 4))
