"""The driver's ``events`` table seen as unified audit events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditweave.session import use_utc

AGENTS = (
    "aws-cli/2.15.30 Python/3.11.6 Linux/5.10",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X) AppleWebKit/605.1.15 Safari/605.1.15",
    "curl/8.4.0",
    "Mozilla/5.0 (X11; Linux x86_64)",
)
FAMILIES = ("aws-cli", "Chrome", "Safari", "curl", "Other")
VERSIONS = ("2.15.30", "120.0.0.0", "605.1.15", "8.4.0", "Unknown")


def _pick(number: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} {cases} END"


# Column expressions that mean the same in Spark SQL and DuckDB.
COLUMNS = {
    "principal": "concat('user_', user_id)",
    "source_cloud": _pick("(user_id + event_id) % 3", ("AWS", "AZURE", "GCP")),
    "home_cloud": _pick("user_id % 3", ("AWS", "AZURE", "GCP")),
    "action": "CASE event_type WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'SetIamPolicy'"
    " WHEN 'view' THEN 'GetUser' WHEN 'click' THEN 'ListRoles' ELSE 'ConsoleLogin' END",
    "status": "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END",
    "resource": "concat('res-', k % 13)",
    "source_ip": "concat('203.0.113.', k)",
    "user_agent": _pick("k % 5", AGENTS),
    "ua_family": _pick("k % 5", FAMILIES),
    "ua_version": _pick("k % 5", VERSIONS),
    "principal_type": _pick(
        "user_id % 5", ("IAMUser", "User", "ServiceAccount", "AssumedRole", "Mystery")
    ),
    "is_known_proxy_or_tor": "k % 11 = 0",
    "anomaly_score": "least(1.0, value / 100.0)",
    "threat_category": "CASE WHEN event_type = 'error' THEN 'CredentialAccess'"
    " WHEN event_type = 'purchase' AND value > 150 THEN 'PrivilegeEscalation' ELSE 'Normal' END",
    "is_attack": "CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND value > 150)"
    " THEN 1 ELSE 0 END",
    "severity_score": "value / 25.0",
    "predicted_phase": "CASE WHEN value > 90 THEN 'Impact' WHEN value > 50 THEN 'Discovery'"
    " ELSE 'Normal' END",
    "phase_confidence": "round(least(1.0, 0.3 + value / 200.0), 4)",
}

_BASE = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified events with ``timestamp`` and the columns above."""
    use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS timestamp", "user_id", "event_type",
        "value", f"{_BASE} AS k",
    )
    named = raw.selectExpr("*", *[f"{sql} AS {name}" for name, sql in COLUMNS.items()])
    return named.withColumnRenamed("user_id", "user_no").withColumn("user_id", named["principal"])


def _oracle_columns() -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())


# DuckDB: ``ev`` with the same columns, event time as epoch microseconds in ``t``.
EV = (
    "raw_ev AS (SELECT event_id, epoch_us(ts) AS t, ts, user_id, event_type, value, "
    f"{_BASE} AS k FROM events), "
    f"ev AS (SELECT *, {_oracle_columns()} FROM raw_ev)"
)
