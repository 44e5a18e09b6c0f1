"""Queries over evaluation, campaigns and corpus quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.functions import events
from auditweave.operators import campaigns, evaluate, quality
from auditweave.plans.adapter import EV, audit_events
from auditweave.plans.registry import query
from auditweave.session import use_utc

# --------------------------------------------------- sweeps on labels x documents

_DOCS = "d AS (SELECT l.quality AS y, CAST(x.n_chars AS DOUBLE) AS s FROM labels l JOIN documents x USING (doc_id))"
_CURVE = f"""{_DOCS}, c AS (SELECT s, count(*) AS n, sum(y) AS p FROM d GROUP BY s),
  tot AS (SELECT count(*) AS n, sum(y) AS p FROM d),
  cum AS (SELECT s, n, p, sum(n) OVER (ORDER BY s DESC) AS flagged, sum(p) OVER (ORDER BY s DESC) AS tp FROM c),
  curve AS (SELECT s AS threshold, cum.n AS n, cum.p AS n_pos, flagged, tp, tp / flagged AS precision,
    CASE WHEN tot.p > 0 THEN tp / tot.p ELSE 0 END AS recall, tot.p AS positives, tot.n AS total,
    CASE WHEN tp > 0 THEN 2 * (tp / flagged) * (tp / tot.p) / (tp / flagged + tp / tot.p + 1e-12)
      ELSE 0 END AS f1 FROM cum, tot)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s")
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "pr_curve",
    f"""WITH {_CURVE} SELECT threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve""",
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluate.pr_curve(_graded(spark, sf_dir), "s", "y")
    return _rounded(
        curve.select("threshold", "flagged", "tp", "precision", "recall", "f1"),
        "precision", "recall", "f1",
    )


_AP = "(SELECT sum(n_pos / positives * precision) FROM curve)"


@query(
    "best_f1_threshold",
    f"""WITH {_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, round({_AP}, 6) AS pr_auc FROM curve ORDER BY f1 DESC, threshold LIMIT 1""",
)
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        evaluate.sweep(_graded(spark, sf_dir), "s", "y"), "precision", "recall", "f1", "pr_auc"
    )


@query(
    "precision_floor_threshold",
    f"""WITH {_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, round({_AP}, 6) AS pr_auc FROM curve
    ORDER BY precision >= 0.6 DESC, CASE WHEN precision >= 0.6 THEN recall ELSE precision END DESC, threshold
    LIMIT 1""",
)
def precision_floor_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        evaluate.sweep(_graded(spark, sf_dir), "s", "y", "precision_floor", 0.6),
        "precision", "recall", "f1", "pr_auc",
    )


@query(
    "average_precision",
    f"WITH {_CURVE} SELECT round({_AP}, 6) AS pr_auc",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        evaluate.average_precision(evaluate.pr_curve(_graded(spark, sf_dir), "s", "y")), "pr_auc"
    )


@query(
    "roc_auc",
    f"""WITH {_CURVE}, neg AS (SELECT n - n_pos AS n, threshold FROM curve)
    SELECT round(sum(n_pos * ((total - positives) - (flagged - tp) + (n - n_pos) / 2))
      / max(positives * (total - positives)), 6) AS roc_auc FROM curve""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.roc_auc(evaluate.pr_curve(_graded(spark, sf_dir), "s", "y")), "roc_auc")


@query(
    "confusion_at_threshold",
    f"""WITH {_DOCS}, c AS (SELECT count(*) FILTER (WHERE s >= 500 AND y = 1) AS tp,
      count(*) FILTER (WHERE s >= 500 AND y = 0) AS fp, count(*) FILTER (WHERE s < 500 AND y = 0) AS tn,
      count(*) FILTER (WHERE s < 500 AND y = 1) AS fn FROM d)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
      round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM c""",
)
def confusion_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.confusion(_graded(spark, sf_dir), "s", "y", 500)
    return _rounded(out, "accuracy", "precision", "recall", "f1", "fpr")


# ----------------------------------------------------------------- on the events

@query(
    "detection_rate_by_category",
    f"""WITH {EV} SELECT threat_category, count(*) FILTER (WHERE anomaly_score >= 0.4) AS flagged,
    count(*) AS total, round(count(*) FILTER (WHERE anomaly_score >= 0.4) / count(*), 6) AS rate
    FROM ev WHERE is_attack = 1 GROUP BY 1""",
)
def detection_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.flagged_rate(
        audit_events(spark, sf_dir), "anomaly_score", 0.4, "threat_category", F.col("is_attack") == 1
    )
    return _rounded(out, "rate")


@query(
    "false_positives_by_cloud",
    f"""WITH {EV} SELECT source_cloud, count(*) FILTER (WHERE anomaly_score >= 0.4) AS flagged,
    count(*) AS total, round(count(*) FILTER (WHERE anomaly_score >= 0.4) / count(*), 6) AS rate
    FROM ev WHERE is_attack = 0 GROUP BY 1""",
)
def false_positives_by_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.flagged_rate(
        audit_events(spark, sf_dir), "anomaly_score", 0.4, "source_cloud", F.col("is_attack") == 0
    )
    return _rounded(out, "rate")


def curve_sql(source: str, score: str) -> str:
    return f"""c AS (SELECT {score} AS s, count(*) AS n, sum(is_attack) AS p FROM {source} GROUP BY 1),
  cum AS (SELECT s, n, p, sum(n) OVER (ORDER BY s DESC) AS flagged, sum(p) OVER (ORDER BY s DESC) AS tp FROM c)"""


@query(
    "base_rate_context",
    f"""WITH {EV}, {curve_sql('ev', 'anomaly_score')}, b AS (SELECT avg(is_attack) AS base_rate,
      count(*) FILTER (WHERE anomaly_score >= 0.8) AS alerts,
      date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS days, sum(is_attack) AS p FROM ev)
    SELECT round(base_rate, 6) AS base_rate, round(ap, 6) AS pr_auc, round(ap / base_rate, 6) AS lift,
      alerts, days, round(alerts / days, 6) AS alerts_per_day
    FROM b, (SELECT sum(p / (SELECT p FROM b) * tp / flagged) AS ap FROM cum)""",
)
def base_rate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.base_rate_context(
        audit_events(spark, sf_dir), "anomaly_score", "is_attack", 0.8
    )
    return _rounded(out, "base_rate", "pr_auc", "lift", "alerts_per_day")


@query(
    "ablation_without_graph",
    f"""WITH {EV}, two AS (SELECT t >= 1705276800000000 AS late, is_attack,
        unnest([struct_pack(signal := 'iforest', a := anomaly_score),
          struct_pack(signal := 'classifier', a := CAST(phase_confidence AS DOUBLE))]) AS u FROM ev),
    r AS (SELECT late, is_attack AS y, u.signal AS signal,
        round((5e-2 + u.a) / (5e-2 + u.a + 1), 4) AS s FROM two),
    c AS (SELECT late, signal, s, count(*) AS n, sum(y) AS p FROM r GROUP BY 1, 2, 3),
    cum AS (SELECT *, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, sum(n) OVER g AS total,
        sum(p) OVER g AS pos FROM c WINDOW w AS (PARTITION BY late, signal ORDER BY s DESC),
        g AS (PARTITION BY late, signal)),
    f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / flagged) * (tp / pos) / (tp / flagged + tp / pos + 1e-12)
        ELSE 0 END AS f1 FROM cum),
    pick AS (SELECT signal, s AS threshold, f1 FROM f WHERE NOT late
        QUALIFY row_number() OVER (PARTITION BY signal ORDER BY f1 DESC, s) = 1),
    auc AS (SELECT signal, sum(p / pos * tp / flagged) AS pr_auc,
        sum(p * ((total - pos) - (flagged - tp) + (n - p) / 2)) / max(pos * (total - pos)) AS roc_auc
        FROM cum WHERE late GROUP BY 1)
    SELECT r.signal, threshold, round(max(pick.f1), 6) AS calibration_f1,
      count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp,
      count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp,
      count(*) FILTER (WHERE s < threshold AND y = 0) AS tn,
      count(*) FILTER (WHERE s < threshold AND y = 1) AS fn,
      round(max(roc_auc), 4) AS roc_auc, round(max(pr_auc), 4) AS pr_auc
    FROM r JOIN pick USING (signal) JOIN auc USING (signal) WHERE late GROUP BY 1, 2""",
)
def ablation_without_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    events_table, calibration = _halves(spark, sf_dir)
    out = evaluate.ablation(events_table, calibration, modes=("isolated",))
    return out.select(
        "signal", "threshold", F.round("calibration_f1", 6).alias("calibration_f1"),
        "tp", "fp", "tn", "fn",
        F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"),
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = audit_events(spark, sf_dir).withColumns(
        {
            "if_score": F.col("anomaly_score"), "clf_score": F.col("phase_confidence").cast("double"),
            "gt_principal": F.col("principal"),
        }
    )
    middle = F.lit("2024-01-15").cast("timestamp")
    return ev.where(F.col("timestamp") >= middle), ev.where(F.col("timestamp") < middle)


@query("ablation_table")
def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six configurations; benign events from before a table's first day are its warm-up."""
    events_table, earlier = _halves(spark, sf_dir)
    start = F.lit("2024-01-08").cast("timestamp")
    benign = F.col("is_attack") == 0
    return evaluate.ablation(
        events_table, earlier.where(F.col("timestamp") >= start),
        warmup=earlier.where(benign),
        calibration_warmup=earlier.where(benign & (F.col("timestamp") < start)),
    )


# -------------------------------------------------------------------- campaigns

_CAMP = f"""{EV}, a AS (SELECT event_id, t, threat_category AS scenario, principal AS actor, anomaly_score AS score,
    t - lag(t) OVER w AS gap FROM ev WHERE is_attack = 1
    WINDOW w AS (PARTITION BY threat_category, principal ORDER BY t, event_id)),
  camp AS (SELECT *, concat_ws('|', scenario, actor, CAST(sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY scenario, actor ORDER BY t, event_id) AS BIGINT)) AS campaign_id FROM a),
  steps AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY t, event_id) AS step FROM camp),
  per AS (SELECT campaign_id, any_value(scenario) AS scenario, count(*) AS n_steps, max(score) AS best,
    min(CASE WHEN score >= 0.7 THEN step END) AS first FROM steps GROUP BY 1)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).where(F.col("is_attack") == 1).select(
        "event_id", "timestamp", F.col("threat_category").alias("scenario"),
        F.col("principal").alias("actor"),
    )


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = campaigns.campaign_map(_labels(spark, sf_dir))
    return campaigns.campaign_scores(audit_events(spark, sf_dir), mapped, "anomaly_score")


@query("campaign_map", f"WITH {_CAMP} SELECT event_id, campaign_id FROM camp")
def campaign_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.campaign_map(_labels(spark, sf_dir)).select("event_id", "campaign_id")


@query(
    "campaign_diagnostics",
    f"""WITH {_CAMP} SELECT count(DISTINCT campaign_id) AS n_campaigns,
    round(max(CASE WHEN gap <= 21600000000 THEN gap END) / 3.6e9, 2) AS max_intra_campaign_gap_h,
    round(min(CASE WHEN gap > 21600000000 THEN gap END) / 3.6e9, 2) AS min_inter_campaign_gap_h FROM camp""",
)
def campaign_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.campaign_diagnostics(campaigns.campaign_map(_labels(spark, sf_dir)))


@query(
    "order_sessions",
    """WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t FROM orders),
    g AS (SELECT *, t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS gap FROM o)
    SELECT o_orderkey, CAST(sum(CASE WHEN gap > 7776000000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS BIGINT) AS session_no FROM g""",
)
def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one customer's orders with no pause above 90 days."""
    from auditweave.operators import ordered

    use_utc(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", events.micros(F.col("o_orderdate")).alias("at")
    )
    out = ordered.sessionize(orders, ["o_custkey"], "at", ["o_orderkey"], 90 * 86_400 * events.MICROS)
    return out.select("o_orderkey", "session_no")


@query("campaign_steps", f"WITH {_CAMP} SELECT campaign_id, scenario, event_id, score, step FROM steps")
def campaign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)


@query(
    "campaign_recall",
    f"""WITH {_CAMP} SELECT count(*) AS n_campaigns, count(first) AS campaigns_detected,
    median(first) AS median_first_detect_step, round(median(first / n_steps), 3) AS median_frac_through,
    round(count(first) / count(*), 6) AS campaign_recall FROM per""",
)
def campaign_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(campaigns.campaign_recall(_steps(spark, sf_dir), 0.7), "campaign_recall")


@query(
    "campaigns_caught_by_scenario",
    f"WITH {_CAMP} SELECT scenario, count(first) AS caught, count(*) AS total FROM per GROUP BY 1",
)
def campaigns_caught_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.caught_per_scenario(_steps(spark, sf_dir), 0.7)


@query(
    "campaign_versus_event_recall",
    f"""WITH {_CAMP}, e AS (SELECT count(*) FILTER (WHERE anomaly_score >= 0.7 AND is_attack = 1) AS tp,
      count(*) FILTER (WHERE anomaly_score >= 0.7 AND is_attack = 0) AS fp,
      count(*) FILTER (WHERE is_attack = 1) AS pos FROM ev)
    SELECT tp, fp, round(tp / (tp + fp), 6) AS event_precision, round(tp / pos, 6) AS event_recall,
      (SELECT count(*) FROM per) AS n_campaigns, (SELECT count(first) FROM per) AS campaigns_detected,
      round((SELECT count(first) / count(*) FROM per), 6) AS campaign_recall,
      round((SELECT count(first) / count(*) FROM per) / (tp / pos), 6) AS campaign_vs_event_recall FROM e""",
)
def campaign_versus_event_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = campaigns.campaign_report(
        audit_events(spark, sf_dir), _steps(spark, sf_dir), 0.7, "anomaly_score"
    ).drop("median_first_detect_step", "median_frac_through")
    return _rounded(out, "event_precision", "event_recall", "campaign_recall", "campaign_vs_event_recall")


@query(
    "matched_precision_point",
    f"""WITH {EV}, {curve_sql('ev', 'anomaly_score')}, tot AS (SELECT sum(is_attack) AS pos FROM ev),
    ok AS (SELECT 0.225 AS target, min(s) AS threshold FROM cum WHERE tp / flagged >= 0.225
      UNION ALL SELECT 0.999, min(s) FROM cum WHERE tp / flagged >= 0.999)
    SELECT CAST(target AS DOUBLE) AS precision_target, ok.threshold IS NOT NULL AS reachable, ok.threshold,
      round(tp / flagged, 6) AS precision, round(tp / pos, 6) AS recall, CAST(tp AS BIGINT) AS tp,
      CAST(flagged - tp AS BIGINT) AS fp
    FROM ok LEFT JOIN cum ON cum.s = ok.threshold CROSS JOIN tot""",
)
def matched_precision_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluate.pr_curve(audit_events(spark, sf_dir), "anomaly_score", "is_attack")
    out = campaigns.matched_precision(curve, 0.225).unionByName(
        campaigns.matched_precision(curve, 0.999)
    )
    return _rounded(out, "precision", "recall")


_TWO = f"""{_CAMP}, ca AS (SELECT DISTINCT campaign_id FROM steps WHERE score >= 0.7),
  cb AS (SELECT DISTINCT campaign_id FROM steps JOIN ev USING (event_id) WHERE phase_confidence >= 0.6)"""


def _caught_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mapped = campaigns.campaign_map(_labels(spark, sf_dir))
    ev = audit_events(spark, sf_dir)
    sides = []
    for score, threshold in (("anomaly_score", 0.7), ("phase_confidence", 0.6)):
        steps = campaigns.campaign_scores(ev, mapped, score, check=False)
        sides.append(campaigns.per_campaign(steps, threshold).where("caught").select("campaign_id"))
    return sides[0], sides[1]


@query(
    "caught_set_comparison",
    f"""WITH {_TWO}, u AS (SELECT campaign_id, ca.campaign_id IS NOT NULL AS a, cb.campaign_id IS NOT NULL AS b
      FROM ca FULL JOIN cb USING (campaign_id))
    SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b,
      count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a AND NOT b) AS only_a,
      count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) AS united,
      round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS jaccard FROM u""",
)
def caught_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _caught_sets(spark, sf_dir)
    return _rounded(campaigns.compare_sets(a, b), "jaccard")


@query(
    "caught_set_differences",
    f"""WITH {_TWO} SELECT campaign_id, 'a' AS side FROM ca WHERE campaign_id NOT IN (FROM cb)
    UNION ALL SELECT campaign_id, 'b' FROM cb WHERE campaign_id NOT IN (FROM ca)""",
)
def caught_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.set_differences(*_caught_sets(spark, sf_dir))


# ------------------------------------------------------------------ multi-class

_CLS = f"""{EV}, m AS (SELECT CASE WHEN value > 100 THEN 'Impact' WHEN value > 40 THEN 'Discovery'
    ELSE 'Normal' END AS truth, predicted_phase AS guess FROM ev),
  cls AS (SELECT c AS class, count(*) FILTER (WHERE truth = c) AS support,
    count(*) FILTER (WHERE guess = c) AS predicted, count(*) FILTER (WHERE truth = c AND guess = c) AS tp
    FROM m, (VALUES ('Impact'), ('Discovery'), ('Normal')) v(c) GROUP BY 1),
  rep AS (SELECT class, support, tp, tp / predicted AS precision, tp / support AS recall,
    2 * tp / (support + predicted) AS f1 FROM cls)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return audit_events(spark, sf_dir).select(
        F.when(value > 100, "Impact").when(value > 40, "Discovery").otherwise("Normal").alias("truth"),
        F.col("predicted_phase").alias("guess"),
    )


@query(
    "class_report",
    f"""WITH {_CLS} SELECT class, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1 FROM rep""",
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        evaluate.class_report(_classified(spark, sf_dir), "truth", "guess"), "precision", "recall", "f1"
    )


@query(
    "class_summary",
    f"""WITH {_CLS} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM rep""",
)
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.class_report(_classified(spark, sf_dir), "truth", "guess")
    return _rounded(evaluate.class_summary(report), "accuracy", "macro_f1")


@query(
    "class_confusion_matrix",
    f"""WITH {_CLS} SELECT truth, count(*) FILTER (WHERE guess = 'Discovery') AS Discovery,
    count(*) FILTER (WHERE guess = 'Impact') AS Impact, count(*) FILTER (WHERE guess = 'Normal') AS Normal
    FROM m GROUP BY 1""",
)
def class_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(
        _classified(spark, sf_dir), "truth", "guess", ["Discovery", "Impact", "Normal"]
    )


# ---------------------------------------------------------------------- quality

_ROLES = f"""{EV}, seen AS (SELECT principal AS identity, 'benign' AS role FROM ev WHERE is_attack = 0 AND user_id % 9 <> 4
    UNION ALL SELECT principal, CASE WHEN is_attack = 1 THEN 'attack' ELSE 'benign' END FROM ev WHERE is_attack = 1
    UNION ALL SELECT concat('user_', user_id + 4), 'created' FROM ev WHERE is_attack = 1 AND k = 5),
  roles AS (SELECT identity, bool_or(role = 'benign') AS in_benign,
    bool_or(role IN ('attack', 'created')) AS in_attack, bool_or(role = 'created') AS is_created
    FROM seen GROUP BY 1)"""


def _role_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benign actors leave out every ninth user, who then only shows up in attacks."""
    ev = audit_events(spark, sf_dir).withColumn("actor", F.col("principal"))
    benign = ev.where((F.col("is_attack") == 0) & (F.col("user_no") % 9 != 4))
    labels = ev.where(F.col("is_attack") == 1).select(
        "actor", F.lit(True).alias("anomaly_flag"),
        F.when(F.col("k") == 5, F.concat(F.lit("user_"), F.col("user_no") + 4)).alias("created"),
    )
    return benign, labels


@query(
    "leaky_identities",
    f"WITH {_ROLES} SELECT identity FROM roles WHERE in_attack AND NOT in_benign AND NOT is_created",
)
def leaky_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.leaky_identities(*_role_tables(spark, sf_dir))


@query(
    "leakage_summary",
    f"""WITH {_ROLES} SELECT count(*) FILTER (WHERE in_benign) AS benign_identities,
    count(*) FILTER (WHERE in_attack) AS attack_identities, count(*) FILTER (WHERE is_created) AS created_identities,
    count(*) FILTER (WHERE in_attack AND NOT in_benign AND is_created) AS allowed_attack_only,
    count(*) FILTER (WHERE in_attack AND NOT in_benign AND NOT is_created) AS leaky,
    count(*) FILTER (WHERE in_attack AND in_benign) AS in_both FROM roles""",
)
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.leakage_summary(quality.identity_roles(*_role_tables(spark, sf_dir)))


@query(
    "anomaly_share_by_cloud",
    f"""WITH {EV} SELECT source_cloud, count(*) AS records,
    round(100.0 * sum(is_attack) / count(*), 6) AS pct_anomalous FROM ev GROUP BY 1""",
)
def anomaly_share_by_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.anomaly_share(audit_events(spark, sf_dir), flag="is_attack")
    return _rounded(out, "pct_anomalous")


_VOCAB = f"""{EV}, r AS (SELECT * FROM ev WHERE source_cloud = 'AWS'), s AS (SELECT * FROM ev WHERE value > 200)"""


def _real_and_made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = audit_events(spark, sf_dir)
    return ev.where(F.col("source_cloud") == "AWS"), ev.where(F.col("value") > 200)


@query(
    "vocabulary_overlap",
    f"""WITH {_VOCAB} SELECT 'action' AS field, count(DISTINCT action) FILTER (WHERE action IN (SELECT action FROM s))
      AS shared, count(DISTINCT action) AS real_values FROM r
    UNION ALL SELECT 'source_ip', count(DISTINCT source_ip) FILTER (WHERE source_ip IN (SELECT source_ip FROM s)),
      count(DISTINCT source_ip) FROM r""",
)
def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, made = _real_and_made(spark, sf_dir)
    return quality.vocabulary_overlap(real, made, "action").unionByName(
        quality.vocabulary_overlap(real, made, "source_ip")
    )


@query(
    "added_values",
    f"""WITH {_VOCAB} SELECT DISTINCT principal FROM r WHERE principal NOT IN (SELECT principal FROM s)""",
)
def added_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, made = _real_and_made(spark, sf_dir)
    return quality.added_values(made, real, "principal")


@query(
    "corpus_statistics",
    f"""WITH {EV}, l AS (SELECT is_attack = 1 AS flag, CASE WHEN is_attack = 1 THEN concat('T', k % 17) ELSE '' END
      AS technique_id, CASE WHEN user_id % 7 = 0 THEN 'holdout' ELSE 'train' END AS split FROM ev)
    SELECT (SELECT count(*) FROM ev) AS total_events, count(*) FILTER (WHERE flag) AS malicious,
      round(100.0 * count(*) FILTER (WHERE flag) / (SELECT count(*) FROM ev), 6) AS malicious_pct,
      count(DISTINCT nullif(technique_id, '')) AS techniques,
      count(*) FILTER (WHERE flag AND split = 'holdout') AS holdout_attacks FROM l""",
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    attack = F.col("is_attack") == 1
    labels = ev.select(
        attack.alias("anomaly_flag"),
        F.when(attack, F.concat(F.lit("T"), F.col("k") % 17)).otherwise("").alias("technique_id"),
        F.when(F.col("user_no") % 7 == 0, "holdout").otherwise("train").alias("victim_split"),
    )
    parts = quality.collect_labels(labels.where("anomaly_flag"), labels.where("not anomaly_flag"))
    return _rounded(quality.corpus_stats(ev, parts), "malicious_pct")


_PROXY_FEATURES = ("status", "ua_family", "source_cloud")


@query(
    "label_proxy_audit",
    f"""WITH {EV}, f AS (SELECT is_attack AS label, unnest([struct_pack(feature := 'status', value := status),
      struct_pack(feature := 'ua_family', value := ua_family),
      struct_pack(feature := 'source_cloud', value := source_cloud)]) AS u FROM ev)
    SELECT label, u.feature AS feature, u.value AS value, count(*) AS n FROM f GROUP BY 1, 2, 3""",
)
def label_proxy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts_by_label(
        audit_events(spark, sf_dir), "is_attack", list(_PROXY_FEATURES)
    )


@query(
    "one_rule_detectors",
    f"""WITH {EV}, f AS (SELECT is_attack AS label, unnest([struct_pack(feature := 'status', value := status),
      struct_pack(feature := 'ua_family', value := ua_family),
      struct_pack(feature := 'source_cloud', value := source_cloud)]) AS u FROM ev)
    SELECT u.feature AS feature, u.value AS value, CAST(sum(label) AS BIGINT) AS tp, count(*) AS flagged,
      round(sum(label) / count(*), 6) AS precision,
      round(sum(label) / (SELECT sum(is_attack) FROM ev), 6) AS recall FROM f GROUP BY 1, 2""",
)
def one_rule_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.one_rule(audit_events(spark, sf_dir), "is_attack", list(_PROXY_FEATURES))
    return _rounded(out, "precision", "recall")


@query(
    "boolean_rule_metrics",
    f"""WITH {EV} SELECT CAST(sum(is_attack) FILTER (WHERE status <> 'SUCCESS') AS BIGINT) AS tp,
    count(*) FILTER (WHERE status <> 'SUCCESS') AS flagged, CAST(sum(is_attack) AS BIGINT) AS positives,
    round(sum(is_attack) FILTER (WHERE status <> 'SUCCESS') / count(*) FILTER (WHERE status <> 'SUCCESS'), 6)
      AS precision,
    round(sum(is_attack) FILTER (WHERE status <> 'SUCCESS') / sum(is_attack), 6) AS recall FROM ev""",
)
def boolean_rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rule_metrics(
        audit_events(spark, sf_dir), "is_attack", F.col("status") != "SUCCESS"
    )
    return _rounded(out, "precision", "recall")

