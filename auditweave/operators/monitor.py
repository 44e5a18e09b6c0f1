"""Dashboard queries over scored events and alert lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.functions.events import micros, normalize_cloud

# Tag, job label, absent value and shape of a report line.
LINE_TAG = "[CRITICAL XAI REPORT]"
LINE_JOB = "security-triage-pipeline"
LINE_ABSENT = "None"
LINE_PATTERN = (
    r"entity=(\S+) principal=(\S+) action=(.*?) risk=([\d.]+|None) phase=(\S+) :: (.*) :: shap=(\{.*\})"
)


def totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if("is_critical").alias("critical_alerts")
    )


def alert_increase(
    scored: DataFrame, length: str = "5 minutes", slide: str | None = "1 minute", ts: str = "timestamp"
) -> DataFrame:
    """Alerts per (sliding) window. Works on streams; set a watermark there."""
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        scored.where("is_critical")
        .groupBy(span.alias("w"))
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alerts")
    )


def ingestion_rate(events: DataFrame, length_seconds: int = 60, ts: str = "timestamp") -> DataFrame:
    """Events per second in tumbling windows."""
    return (
        events.groupBy(F.window(ts, f"{length_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").alias("window_start"), "n",
            (F.col("n") / length_seconds).alias("per_second"),
        )
    )


def phase_counts(scored: DataFrame, clouds: list[str] | None = None) -> DataFrame:
    cloud = normalize_cloud(F.col("source_cloud"))
    rows = scored.select(
        F.coalesce(F.nullif(F.col("predicted_phase"), F.lit("")), F.lit("Normal")).alias("phase"),
        cloud.alias("cloud_provider"),
    )
    if clouds:
        rows = rows.where(F.col("cloud_provider").isin(*clouds))
    return rows.groupBy("phase", "cloud_provider").agg(F.count(F.lit(1)).alias("n"))


def _latest(value: Column, ts: str, order: str) -> Column:
    return F.max_by(value, F.struct(F.col(ts), F.col(order)))


def latest_trust(
    scored: DataFrame, ts: str = "timestamp", order: str = "event_id", red_below: float = 50.0
) -> DataFrame:
    """Newest trust score per identity and cloud."""
    return (
        scored.groupBy(
            F.col("principal").alias("user_identity"),
            normalize_cloud(F.col("source_cloud")).alias("cloud_provider"),
        )
        .agg(_latest(F.col("trust_score"), ts, order).alias("trust_score"))
        .withColumn("is_red", F.col("trust_score") < red_below)
    )


def latest_impacts(scored: DataFrame, ts: str = "timestamp", order: str = "event_id") -> DataFrame:
    """Newest impact per attributed feature and cloud, from the ``attributions`` map."""
    exploded = scored.select(
        normalize_cloud(F.col("source_cloud")).alias("cloud_provider"), ts, order,
        F.explode("attributions").alias("feature_name", "a"),
    )
    return exploded.groupBy("feature_name", "cloud_provider").agg(
        _latest(F.col("a.impact"), ts, order).alias("impact")
    )


def latest_engine_scores(scored: DataFrame, ts: str = "timestamp", order: str = "event_id") -> DataFrame:
    """Newest score per engine and cloud, one row each."""
    newest = scored.groupBy(normalize_cloud(F.col("source_cloud")).alias("cloud_provider")).agg(
        _latest(F.col("if_anomaly_score"), ts, order).alias("iforest"),
        _latest(F.col("anomaly_score"), ts, order).alias("attack"),
        _latest(F.col("phase_confidence"), ts, order).alias("confidence"),
    )
    return newest.unpivot(
        ["cloud_provider"], ["iforest", "attack", "confidence"], "engine_name", "score"
    )


def latest_risk(scored: DataFrame, ts: str = "timestamp", order: str = "event_id") -> DataFrame:
    """Risk intensity and cloud span of the newest scored event, one row."""
    newest = F.struct("risk_intensity", "cloud_span_count")
    return scored.agg(_latest(newest, ts, order).alias("r")).select("r.*")


def _said(value: Column) -> Column:
    """The value in a line; a missing one is spelled out, so that no line gets lost."""
    return F.coalesce(value, F.lit(LINE_ABSENT))


def _score_text(column: str) -> Column:
    return _said(F.when(F.col(column).isNotNull(), F.format_string("%.4f", F.col(column))))


def alert_text() -> Column:
    """Structured summary used where no narrative exists."""
    return F.concat(
        F.lit("phase="), _said(F.col("predicted_phase")),
        F.lit(" dominant_signal="), _said(F.col("dominant_signal")),
        F.lit(" clouds="), _said(F.array_join("active_clouds", ",")),
        F.lit(" scaled_score="), _score_text("scaled_score"),
    )


def alert_lines(alerts: DataFrame, text: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """One report line per alert with low-cardinality labels for the sink's partitions."""
    body = alert_text() if text is None else _said(text)
    clean = F.trim(F.regexp_replace(F.regexp_replace(body, "\n", " "), '"', "'"))
    impacts = (
        F.coalesce(F.to_json("attributions"), F.lit("{}")) if "attributions" in alerts.columns else F.lit("{}")
    )
    line = F.concat(
        F.lit(f"{LINE_TAG} entity="), _said(F.col("entity_id")),
        F.lit(" principal="), _said(F.coalesce(F.col("principal"), F.col("entity_id"))),
        F.lit(" action="), _said(F.col("action")),
        F.lit(" risk="), _score_text("scaled_score"),
        F.lit(" phase="), _said(F.col("predicted_phase")),
        F.lit(" :: "), clean, F.lit(" :: shap="), impacts,
    )
    return alerts.select(
        F.lit(LINE_JOB).alias("job"),
        normalize_cloud(F.col("source_cloud")).alias("cloud"),
        F.coalesce(F.col("predicted_phase"), F.lit("Normal")).alias("phase"),
        micros(F.col(ts)).alias("ts_us"),
        line.alias("line"),
    )


def parse_alert_lines(
    lines: DataFrame, contains: str = LINE_TAG, clouds: list[str] | None = None
) -> DataFrame:
    """Columns back from report lines, newest first."""
    rows = lines.where(F.col("line").contains(contains))
    if clouds:
        rows = rows.where(F.col("cloud").isin(*clouds))
    names = ("entity", "principal", "action", "risk", "phase_line", "narrative", "shap")
    return (
        rows.where(F.col("line").rlike(LINE_PATTERN))
        .select(
            "ts_us", "cloud", "phase",
            *[F.regexp_extract("line", LINE_PATTERN, i + 1).alias(n) for i, n in enumerate(names)],
        )
        .withColumn("risk", F.col("risk").try_cast("double"))
        .orderBy(F.col("ts_us").desc())
    )


def narration_summary(telemetry: DataFrame) -> DataFrame:
    """Mean latency and prompt size per model over successful calls only."""
    return telemetry.where("succeeded").groupBy("model_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("elapsed_seconds").alias("avg_latency"),
        F.avg("prompt_chars").alias("avg_prompt_chars"),
    )
