"""Queries over features, windows and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.functions import events
from auditweave.operators import features, monitor, risk
from auditweave.plans.adapter import EV, audit_events
from auditweave.plans.registry import query
from auditweave.sources import sinks


ROW_SQL = """SELECT event_id, CAST(extract(hour FROM ts) AS INT) AS hour_of_day,
      CAST(isodow(ts) - 1 AS INT) AS day_of_week,
      CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 1 ELSE 0 END AS is_night_access,
      CASE WHEN hour(ts) BETWEEN 8 AND 18 THEN 1 ELSE 0 END AS is_business_hour,
      0 AS mfa_authenticated, 0 AS principal_created_in_window,
      CASE WHEN regexp_matches(lower(principal), 'svc|role|arn:|service') THEN 1 ELSE 0 END
        AS user_type_is_service,
      'UNKNOWN' AS account_type, principal_type,
      CASE WHEN k % 11 = 0 THEN 'True' ELSE 'False' END AS is_known_proxy_or_tor,
      ua_family, ua_version, 'Unknown' AS device_compliant_status, 'Unknown' AS geo_country,
      CASE WHEN user_agent LIKE '%Chrome%' THEN 'Chrome' WHEN user_agent LIKE '%Firefox%'
        THEN 'Firefox' WHEN user_agent LIKE '%Safari%' THEN 'Safari' ELSE 'Unknown' END
        AS browser_type,
      CASE WHEN user_agent LIKE '%Windows%' THEN 'Windows' WHEN user_agent LIKE '%Mac%'
        THEN 'Mac' WHEN user_agent LIKE '%Linux%' THEN 'Linux' ELSE 'Unknown' END AS os_type,
      CASE WHEN action IN ('CreateUser', 'SetIamPolicy') THEN 4 ELSE 1 END
        AS action_sensitivity_score,
      CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END AS login_result_success,
      1 AS is_internal_ip
    FROM ev"""


@query("feature_row_columns", f"WITH {EV} {ROW_SQL}")
def feature_row_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.action_features(
        features.identity_and_network(features.temporal(audit_events(spark, sf_dir)))
    )
    return out.select(
        "event_id", "hour_of_day", "day_of_week", "is_weekend", "is_night_access",
        "is_business_hour", "mfa_authenticated", "principal_created_in_window",
        "user_type_is_service", "account_type", "principal_type", "is_known_proxy_or_tor",
        "ua_family", "ua_version", "device_compliant_status", "geo_country", "browser_type",
        "os_type", "action_sensitivity_score", "login_result_success", "is_internal_ip",
    )


def _trailing(seconds: int) -> str:
    return (
        f"(PARTITION BY principal ORDER BY t RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING "
        "AND CURRENT ROW)"
    )


_READ = "CASE WHEN regexp_matches(action, '(?i)Get|List|Describe|Read') THEN 1 ELSE 0 END"
BEHAVIOUR_SQL = f"""SELECT event_id,
  CASE WHEN row_number() OVER (PARTITION BY principal, source_ip ORDER BY t, event_id) = 1
    THEN 1 ELSE 0 END AS is_new_ip_for_user,
  CASE WHEN row_number() OVER (PARTITION BY principal, CASE k % 5 WHEN 4 THEN 0 ELSE k % 5 END
    ORDER BY t, event_id) = 1
    THEN 1 ELSE 0 END AS is_new_device_for_user,
  count(*) OVER {_trailing(60)} AS api_call_count_1m,
  round(avg(CASE WHEN status = 'SUCCESS' THEN 0.0 ELSE 1.0 END) OVER {_trailing(300)}, 6)
    AS error_rate_5m,
  round(CAST(sum({_READ}) OVER {_trailing(3600)} AS DOUBLE)
    / greatest(sum(1 - {_READ}) OVER {_trailing(3600)}, 1), 6) AS read_vs_write_ratio,
  count(DISTINCT resource) OVER {_trailing(86400)} AS unique_resources_accessed,
  count(DISTINCT source_ip) OVER {_trailing(86400)} AS unique_ips_last_24h,
  CAST(sum(CASE WHEN action IN ('CreateUser', 'SetIamPolicy') THEN 1 ELSE 0 END)
    OVER {_trailing(86400)} AS BIGINT) AS privileged_actions_last_24h
  FROM ev"""


@query("feature_windows", f"WITH {EV} {BEHAVIOUR_SQL}")
def feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.features(audit_events(spark, sf_dir))
    return out.select(
        "event_id", "is_new_ip_for_user", "is_new_device_for_user", "api_call_count_1m",
        F.round("error_rate_5m", 6).alias("error_rate_5m"),
        F.round("read_vs_write_ratio", 6).alias("read_vs_write_ratio"),
        "unique_resources_accessed", "unique_ips_last_24h", "privileged_actions_last_24h",
    )


_WINDOWED = (
    "is_new_device_for_user", "api_call_count_1m", "error_rate_5m", "read_vs_write_ratio",
    "unique_resources_accessed", "unique_ips_last_24h", "privileged_actions_last_24h",
)


def matrix_sql(labeled: bool) -> str:
    """The feature columns by name, from the row columns, the windows and the event itself."""
    wanted = ", ".join(
        {"action": "ev.action", "source_cloud": "ev.source_cloud"}.get(c, f"w.{c}" if c in _WINDOWED else f"r.{c}")
        for c in features.feature_columns(labeled)
    )
    return (
        f"WITH {EV}, r AS ({ROW_SQL}), w AS ({BEHAVIOUR_SQL}) SELECT event_id, {wanted} "
        "FROM ev JOIN r USING (event_id) JOIN w USING (event_id)"
    )


def _matrix(spark: SparkSession, sf_dir: str, labeled: bool) -> DataFrame:
    x, _ = features.split_features(features.features(audit_events(spark, sf_dir)), labeled)
    return x.withColumns({c: F.round(c, 6) for c in ("error_rate_5m", "read_vs_write_ratio")})


@query("feature_matrix", matrix_sql(labeled=False))
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X of unlabeled operation, 24 columns."""
    return _matrix(spark, sf_dir, labeled=False)


@query("feature_matrix_labeled", matrix_sql(labeled=True))
def feature_matrix_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X with the four columns that only vary on labeled data, 28 columns."""
    return _matrix(spark, sf_dir, labeled=True)


@query(
    "feature_targets_isolated",
    f"""WITH {EV}
    SELECT event_id, CASE WHEN severity_score >= 4 THEN 4 WHEN severity_score >= 3 THEN 3
      WHEN severity_score >= 2 THEN 2 ELSE 1 END AS severity, severity_score, threat_category
    FROM ev""",
)
def feature_targets_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    ev = ev.withColumn("severity", events.severity_from_score(F.col("severity_score")))
    _, y = features.split_features(features.features(ev), labeled=True)
    return y


_CODED = ("source_cloud", "action", "user_id", "principal_type", "ua_family", "browser_type", "os_type")


@query(
    "categorical_codes",
    f"""WITH {EV}, f AS (SELECT event_id, source_cloud, action, CAST(user_id AS VARCHAR) AS user_id, principal_type, ua_family,
      CASE WHEN user_agent LIKE '%Chrome%' THEN 'Chrome' WHEN user_agent LIKE '%Firefox%' THEN 'Firefox'
        WHEN user_agent LIKE '%Safari%' THEN 'Safari' ELSE 'Unknown' END AS browser_type,
      CASE WHEN user_agent LIKE '%Windows%' THEN 'Windows' WHEN user_agent LIKE '%Mac%'
        THEN 'Mac' WHEN user_agent LIKE '%Linux%' THEN 'Linux' ELSE 'Unknown' END AS os_type FROM ev)
    SELECT event_id, """
    + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in _CODED
    )
    + " FROM f",
)
def categorical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features.features(audit_events(spark, sf_dir))
    encoded = features.encode(features.fit_encoder(feats, also=["user_id", "browser_type"]), feats)
    return encoded.select("event_id", *[F.col(f"{c}__code").alias(c) for c in _CODED])


# ------------------------------------------------------------------------ risk

_CLOUD = "source_cloud"
_AUTOMATION = (
    "(principal_type IN ('ServiceAccount', 'AssumedRole') OR max(CASE WHEN ua_family IN "
    "('aws-cli', 'curl') THEN 1 ELSE 0 END) OVER w60 = 1)"
)


def risk_sql(baselines: bool = False) -> str:
    """Risk per event with principals as entities, straight from window frames."""
    novel = (
        "CASE WHEN len(base) > 0 THEN len(list_filter(life, lambda x: NOT list_contains(base, x))) "
        "ELSE greatest(len(life) - 1, 0) END"
        if baselines
        else "greatest(len(life) - 1, 0)"
    )
    join = (
        "LEFT JOIN (SELECT principal, list(DISTINCT source_cloud) AS base FROM ev "
        "WHERE is_attack = 0 AND t < 1704672000000000 GROUP BY principal) b USING (principal)"
        if baselines
        else ""
    )
    return f"""WITH {EV}, win AS (
      SELECT event_id, t, principal, source_cloud,
        list(struct_pack(t := t, a := anomaly_score)) OVER w60 AS active,
        len(list_distinct(list(source_cloud) OVER w60)) AS window_clouds,
        list_sort(list_distinct(list(source_cloud) OVER (PARTITION BY principal
          ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS life,
        CASE WHEN {_AUTOMATION} THEN 'automation' ELSE 'human' END AS principal_class
      FROM ev
      WINDOW w60 AS (PARTITION BY principal ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)
    ), n AS (SELECT win.*, {novel} AS novel,
        list_sum(list_transform(active, lambda x: x.a * pow(0.5, (win.t - x.t) / 1e6 / 1800.0))) AS decayed
      FROM win {join}
    ), m AS (SELECT *, pow(CASE WHEN principal_class = 'human' THEN 3e0 ELSE 1.7e0 END, novel) AS mult FROM n
    ), r AS (SELECT *, 5e-2 + mult * decayed AS risk FROM m)
    SELECT event_id, round(risk, 6) AS risk_intensity, round(risk / (risk + 1), 4) AS scaled_score,
      len(life) AS cloud_span_count, window_clouds AS window_cloud_span_count,
      novel AS novel_cloud_span_count, array_to_string(life, ',') AS active_clouds,
      round(mult, 4) AS diversity_multiplier, principal_class,
      risk / (risk + 1) >= 0.75 AS is_critical,
      CASE WHEN risk <= 5e-2 * 1.5e0 THEN 'baseline_only' WHEN novel >= 1 THEN 'cross_cloud_diversity'
        WHEN decayed > 5e-2 * 5e0 THEN 'high_event_volume' ELSE 'recent_activity_accumulation' END
        AS dominant_signal, len(active) AS window_events
    FROM r"""


def _risk_columns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "event_id", "risk_intensity", "scaled_score",
        "cloud_span_count", "window_cloud_span_count", "novel_cloud_span_count",
        F.array_join("active_clouds", ",").alias("active_clouds"), "diversity_multiplier",
        "principal_class", "is_critical", "dominant_signal", "window_events",
    )


def scored_events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("entity_id", F.col("principal"))
    return risk.score(ev, **options)


@query("entity_risk", risk_sql())
def entity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk_columns(scored_events(spark, sf_dir))


@query("entity_risk_with_baselines", risk_sql(baselines=True))
def entity_risk_with_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds of the benign first week are each principal's normal footprint."""
    ev = audit_events(spark, sf_dir).withColumn("entity_id", F.col("principal"))
    quiet = ev.where((F.col("is_attack") == 0) & (F.col("timestamp") < F.lit("2024-01-08").cast("timestamp")))
    return _risk_columns(risk.score(ev, baselines=risk.footprints(quiet)))


_TYPES = ("IAMUser", "User", "ServiceAccount", "AssumedRole", "Mystery", "Puzzle", "Riddle")


@query(
    "principal_class_from_window",
    f"""WITH {EV}, c AS (SELECT event_id, home_cloud, t // 600000000 * 600000000 AS t,
      CASE k % 7 WHEN 0 THEN 'IAMUSER' WHEN 1 THEN 'USER' WHEN 2 THEN 'SERVICEACCOUNT'
        WHEN 3 THEN 'ASSUMEDROLE' WHEN 4 THEN 'MYSTERY' WHEN 5 THEN 'PUZZLE' ELSE 'RIDDLE' END AS pt FROM ev),
    g AS (SELECT c.event_id, o.pt, count(*) AS n, min(struct_pack(t := o.t, e := o.event_id)) AS first FROM c JOIN c o
      ON c.home_cloud = o.home_cloud AND o.t >= c.t - 3600000000 AND (o.t, o.event_id) <= (c.t, c.event_id)
      GROUP BY 1, 2),
    m AS (SELECT event_id, arg_max(pt, struct_pack(n := n, t := -first.t, e := -first.e)) AS pt FROM g GROUP BY 1)
    SELECT event_id, CASE WHEN pt IN ('SERVICEACCOUNT', 'ASSUMEDROLE') THEN 'automation'
      ELSE 'human' END AS principal_class FROM m""",
)
def principal_class_from_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as wide as a cloud, one-hour windows and times to ten minutes: types mix, times tie."""
    ev = audit_events(spark, sf_dir)
    types = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), F.col("k") % 7 + 1)
    mixed = ev.select(
        "event_id", F.window("timestamp", "10 minutes")["start"].alias("timestamp"), "source_cloud", "anomaly_score",
        F.col("home_cloud").alias("entity_id"), types.alias("principal_type"),
    )
    return risk.score(
        mixed, params=risk.RiskParams(window_seconds=3600.0), class_from="window"
    ).select("event_id", "principal_class")


@query(
    "isolated_risk",
    f"""WITH {EV}, r AS (SELECT event_id, ua_family, principal_type, 0.05 + anomaly_score AS risk FROM ev)
    SELECT event_id, round(risk, 6) AS risk_intensity, round(risk / (risk + 1), 4) AS scaled_score,
      CASE WHEN principal_type IN ('ServiceAccount', 'AssumedRole') OR ua_family IN ('aws-cli', 'curl')
        THEN 'automation' ELSE 'human' END AS principal_class,
      round(100 * (1 - round(risk / (risk + 1), 4)), 4) AS trust_score FROM r""",
)
def isolated_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.isolated(audit_events(spark, sf_dir))
    return out.select(
        "event_id", "risk_intensity", "scaled_score", "principal_class",
        F.round("trust_score", 4).alias("trust_score"),
    )


@query(
    "active_window",
    f"""WITH {EV}
    SELECT event_id, count(*) OVER w AS active_events, min(t) OVER w AS window_start_us FROM ev
    WINDOW w AS (PARTITION BY principal ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""",
)
def active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.active_window(audit_events(spark, sf_dir), entity="principal")
    return out.select(
        "event_id", "active_events", events.micros(F.col("window_start")).alias("window_start_us")
    )


@query(
    "cloud_footprints",
    f"""WITH {EV}
    SELECT principal AS entity_id, array_to_string(list_sort(list(DISTINCT source_cloud)), ',') AS clouds
    FROM ev GROUP BY 1""",
)
def cloud_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("entity_id", F.col("principal"))
    return risk.footprints(ev).select("entity_id", F.array_join("clouds", ",").alias("clouds"))


@query(
    "recorded_baselines",
    f"""WITH {EV}, b AS (SELECT principal AS entity_id, source_cloud FROM ev WHERE is_attack = 0
      UNION SELECT principal, home_cloud FROM ev)
    SELECT entity_id, array_to_string(list_sort(list(DISTINCT source_cloud)), ',') AS clouds
    FROM b GROUP BY 1""",
)
def recorded_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("entity_id", F.col("principal"))
    learned = risk.footprints(ev.where(F.col("is_attack") == 0))
    known = ev.groupBy("entity_id").agg(F.collect_set("home_cloud").alias("clouds"))
    return risk.merge_footprints(learned, known).select(
        "entity_id", F.array_join("clouds", ",").alias("clouds")
    )


@query(
    "risk_contributions",
    f"""WITH {EV}, l AS (SELECT principal, max(t) AS now FROM ev GROUP BY 1)
    SELECT ev.principal AS entity_id, event_id, source_cloud,
      round(anomaly_score, 4) AS anomaly_score, round((now - t) / 1e6, 2) AS age_seconds,
      round(pow(0.5, (now - t) / 1e6 / 1800.0), 4) AS weight,
      round(anomaly_score * pow(0.5, (now - t) / 1e6 / 1800.0), 6) AS contribution
    FROM ev JOIN l USING (principal) WHERE now - t <= 60000000""",
)
def risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("entity_id", F.col("principal"))
    return risk.contributions(ev).drop("principal")


@query(
    "benign_rank_threshold",
    f"""WITH {EV}, s AS (SELECT (0.05 + anomaly_score) / (1.05 + anomaly_score) AS scaled FROM ev
      WHERE is_attack = 0),
    o AS (SELECT scaled, row_number() OVER (ORDER BY scaled) - 1 AS i, count(*) OVER () AS n FROM s)
    SELECT round(least(0.999, scaled), 4) AS threshold, n AS n_benign FROM o
    WHERE i = least(CAST(floor(n * 95 / 100.0) AS BIGINT), n - 1)""",
)
def benign_rank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    benign = audit_events(spark, sf_dir).where(F.col("is_attack") == 0)
    return risk.nearest_rank_threshold(
        benign.withColumn("risk_intensity", 0.05 + F.col("anomaly_score"))
    )


@query(
    "latest_risk_per_entity",
    f"""WITH r AS ({risk_sql()}), {EV}
    SELECT principal AS entity_id, arg_max(risk_intensity, t) AS risk_intensity,
      arg_max(scaled_score, t) AS scaled_score, arg_max(cloud_span_count, t) AS cloud_span_count,
      arg_max(is_critical, t) AS is_critical
    FROM ev JOIN r USING (event_id) GROUP BY 1""",
)
def latest_risk_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir).select(
        "entity_id", "timestamp", "event_id",
        "risk_intensity", "scaled_score",
        "cloud_span_count", "is_critical",
    )
    latest = sinks.latest_per_key(scored, "entity_id", ["timestamp", "event_id"])
    return latest.drop("timestamp", "event_id")


# ------------------------------------------------------------------- dashboards

@query(
    "dashboard_totals",
    f"""WITH r AS ({risk_sql()})
    SELECT count(*) AS total_events, count(*) FILTER (WHERE is_critical) AS critical_alerts FROM r""",
)
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.totals(scored_events(spark, sf_dir))


_ISO_CRITICAL = "(0.05 + anomaly_score) / (1.05 + anomaly_score) >= 0.45"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.isolated(audit_events(spark, sf_dir), risk.RiskParams(alert_threshold=0.45))


@query(
    "alerts_last_5_minutes",
    f"""WITH {EV}, a AS (SELECT t FROM ev WHERE {_ISO_CRITICAL}),
    w AS (SELECT t // 60000000 * 60000000 - i * 60000000 AS s FROM a, range(0, 5) r(i))
    SELECT s AS window_start_us, count(*) AS alerts FROM w GROUP BY 1""",
)
def alerts_last_5_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.alert_increase(_alerts(spark, sf_dir)).select(
        events.micros(F.col("window_start")).alias("window_start_us"), "alerts"
    )


@query(
    "alerts_per_minute",
    f"""WITH {EV} SELECT t // 60000000 * 60000000 AS window_start_us, count(*) AS alerts
    FROM ev WHERE {_ISO_CRITICAL} GROUP BY 1""",
)
def alerts_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.alert_increase(_alerts(spark, sf_dir), "1 minute", None).select(
        events.micros(F.col("window_start")).alias("window_start_us"), "alerts"
    )


@query(
    "ingestion_rate",
    f"""WITH {EV} SELECT t // 60000000 * 60000000 AS window_start_us, count(*) AS n,
      round(count(*) / 60.0, 6) AS per_second FROM ev GROUP BY 1""",
)
def ingestion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.ingestion_rate(audit_events(spark, sf_dir)).select(
        events.micros(F.col("window_start")).alias("window_start_us"), "n",
        F.round("per_second", 6).alias("per_second"),
    )


@query(
    "phase_counts_by_cloud",
    f"""WITH {EV} SELECT predicted_phase AS phase, source_cloud AS cloud_provider, count(*) AS n
    FROM ev WHERE source_cloud IN ('AWS', 'GCP') GROUP BY 1, 2""",
)
def phase_counts_by_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.phase_counts(audit_events(spark, sf_dir), ["AWS", "GCP"])


@query(
    "latest_trust_scores",
    f"""WITH {EV}, s AS (SELECT principal AS user_identity, source_cloud AS cloud_provider,
      arg_max(round(100 * (1 - round((0.05 + anomaly_score) / (1.05 + anomaly_score), 4)), 4), t)
        AS trust_score FROM ev GROUP BY 1, 2)
    SELECT *, trust_score < 50 AS is_red FROM s""",
)
def latest_trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latest_trust(_alerts(spark, sf_dir)).withColumn(
        "trust_score", F.round("trust_score", 4)
    )


def _with_attributions(df: DataFrame) -> DataFrame:
    """Stand-in attributions computed from the row, for the queries that read them."""
    def part(raw, impact):
        return F.struct(raw.cast("string").alias("raw_value"), F.round(impact, 4).alias("impact"))

    return df.withColumn(
        "attributions",
        F.create_map(
            F.lit("action"), part(F.col("action"), F.col("value") / 1000.0),
            F.lit("source_ip"), part(F.col("source_ip"), F.col("k") / 100.0),
        ),
    )


@query(
    "latest_feature_impacts",
    f"""WITH {EV}, i AS (SELECT 'action' AS feature_name, source_cloud, t, round(value / 1000.0, 4) AS v FROM ev
      UNION ALL SELECT 'source_ip', source_cloud, t, round(k / 100.0, 4) FROM ev)
    SELECT feature_name, source_cloud AS cloud_provider, arg_max(v, t) AS impact FROM i GROUP BY 1, 2""",
)
def latest_feature_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latest_impacts(_with_attributions(audit_events(spark, sf_dir)))


@query(
    "latest_engine_scores",
    f"""WITH {EV}, l AS (SELECT source_cloud, arg_max(round(k / 100.0, 4), t) AS iforest,
      arg_max(anomaly_score, t) AS attack, arg_max(phase_confidence, t) AS confidence FROM ev GROUP BY 1)
    SELECT source_cloud AS cloud_provider, 'iforest' AS engine_name, CAST(iforest AS DOUBLE) AS score FROM l
    UNION ALL SELECT source_cloud, 'attack', attack FROM l
    UNION ALL SELECT source_cloud, 'confidence', CAST(confidence AS DOUBLE) FROM l""",
)
def latest_engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("if_anomaly_score", F.round(F.col("k") / 100.0, 4))
    return monitor.latest_engine_scores(ev)


@query(
    "latest_risk_gauge",
    f"""WITH r AS ({risk_sql()}), {EV}
    SELECT arg_max(risk_intensity, t) AS risk_intensity, arg_max(cloud_span_count, t) AS cloud_span_count
    FROM ev JOIN r USING (event_id)""",
)
def latest_risk_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir)
    return monitor.latest_risk(scored)


# Some actions, phases and texts are missing.
_ACTION = "CASE WHEN k % 7 = 0 THEN 'None' ELSE action END"
_PHASE = "CASE WHEN k % 5 <> 0 THEN predicted_phase END"
_SEEN = "CASE WHEN k % 3 = 0 THEN 'None' ELSE concat('seen ''', user_agent, ''' from ', source_ip) END"
_LINE = f"""concat('[CRITICAL XAI REPORT] entity=', principal, ' principal=', principal, ' action=', {_ACTION},
  ' risk=', printf('%.4f', round((0.05 + anomaly_score) / (1.05 + anomaly_score), 4)),
  ' phase=', coalesce({_PHASE}, 'None'), ' :: ', {_SEEN}, ' :: shap={{}}')"""


@query(
    "alert_report_lines",
    f"""WITH {EV}
    SELECT source_cloud AS cloud, coalesce({_PHASE}, 'Normal') AS phase, t AS ts_us, {_LINE} AS line
    FROM ev WHERE {_ISO_CRITICAL}""",
)
def alert_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).drop("job")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).where("is_critical").withColumns(
        {
            "entity_id": F.col("principal"),
            "action": F.when(F.col("k") % 7 != 0, F.col("action")),
            "predicted_phase": F.when(F.col("k") % 5 != 0, F.col("predicted_phase")),
        }
    )
    seen = F.concat(
        F.lit('seen "'), F.col("user_agent"), F.lit('"\nfrom '), F.col("source_ip"), F.lit(" ")
    )
    text = F.when(F.col("k") % 3 != 0, seen)
    return monitor.alert_lines(alerts, text)


@query(
    "parsed_alert_lines",
    f"""WITH {EV}
    SELECT t AS ts_us, source_cloud AS cloud, coalesce({_PHASE}, 'Normal') AS phase, principal AS entity,
      principal, {_ACTION} AS action, round((0.05 + anomaly_score) / (1.05 + anomaly_score), 4) AS risk,
      coalesce({_PHASE}, 'None') AS phase_line, {_SEEN} AS narrative,
      '{{}}' AS shap
    FROM ev WHERE {_ISO_CRITICAL} AND source_cloud IN ('AWS', 'AZURE')""",
)
def parsed_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.parse_alert_lines(_report(spark, sf_dir), clouds=["AWS", "AZURE"])


@query(
    "narration_summary",
    f"""WITH {EV}
    SELECT home_cloud AS model_name, count(*) AS calls, round(avg(value / 10.0), 6) AS avg_latency,
      avg(k * 10) AS avg_prompt_chars FROM ev WHERE status = 'SUCCESS' GROUP BY 1""",
)
def narration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call telemetry derived from the events: one model per home cloud."""
    calls = audit_events(spark, sf_dir).select(
        F.col("home_cloud").alias("model_name"), (F.col("status") == "SUCCESS").alias("succeeded"),
        (F.col("value") / 10.0).alias("elapsed_seconds"), (F.col("k") * 10).alias("prompt_chars"),
    )
    return monitor.narration_summary(calls).withColumn("avg_latency", F.round("avg_latency", 6))


@query(
    "alert_ledger",
    f"""WITH {EV}
    SELECT principal AS entity_id, predicted_phase, t AS ts_us FROM ev
    WHERE {_ISO_CRITICAL} AND phase_confidence > 0.8""",
)
def alert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).where("is_critical").withColumns(
        {
            "entity_id": F.col("principal"), "narrative": monitor.alert_text(),
            "passed_gate": F.col("phase_confidence") > 0.8,
        }
    )
    return sinks.ledger_rows(alerts).select(
        "entity_id", "predicted_phase", events.micros(F.col("timestamp")).alias("ts_us")
    )


@query(
    "alert_signatures",
    f"""WITH {EV}, s AS (SELECT t, predicted_phase, sha256(concat(predicted_phase, '|[''action'', ''source_ip'']|',
      CAST(round(phase_confidence, 1) AS VARCHAR))) AS signature FROM ev WHERE {_ISO_CRITICAL})
    SELECT signature, count(*) AS n_alerts, min(t) AS first_us, max(t) AS last_us,
      any_value(predicted_phase) AS predicted_phase FROM s GROUP BY 1""",
)
def alert_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditweave.operators import explain

    alerts = _with_attributions(_alerts(spark, sf_dir).where("is_critical"))
    grouped = explain.group_alerts(alerts)
    return grouped.select(
        "signature", "n_alerts", events.micros(F.col("first_seen")).alias("first_us"),
        events.micros(F.col("last_seen")).alias("last_us"), "predicted_phase",
    )
