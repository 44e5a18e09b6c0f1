"""Writers: normalized events, dead letters, latest state, alert ledger, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.operators import monitor


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by event date and cloud, so scans prune on both."""
    out = df.withColumn("event_date", F.to_date("timestamp"))
    out.write.mode(mode).partitionBy("event_date", "source_cloud").parquet(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_dead_letters(dead: DataFrame, path: str, mode: str = "append") -> None:
    dead.select("error", "raw_log").write.mode(mode).json(path)


def export_scored(df: DataFrame, path: str, score: str = "anomaly_score") -> None:
    """Every scored event, highest score first."""
    export_csv(df.orderBy(F.col(score).desc()), path)


def export_curve(curve: DataFrame, path: str) -> None:
    export_csv(curve.select("threshold", "precision", "recall", "f1").orderBy("threshold"), path)


# ---------------------------------------------------------------- latest state

def latest_per_key(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The newest row of each key; summed on the map side, so a hot key is cheap."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__key")).agg(
        F.max_by(row, F.struct(*seq)).alias("__row")
    ).select("__row.*")


def upsert_latest(df: DataFrame, key: str, seq: list[str], path: str, batch_id: int) -> None:
    """Insert or update by key.

    Each batch writes only its own newest rows, under its batch id: a retried batch
    replaces itself, and the cost follows the changed keys, not the whole state.
    """
    latest_per_key(df, key, seq).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_latest(spark: SparkSession, path: str, key: str, seq: list[str]) -> DataFrame | None:
    """Current state: the newest row per key over all batches; None before the first one."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return latest_per_key(stored, key, [*seq, "batch_id"]).drop("batch_id")


def compact_latest(spark: SparkSession, path: str, key: str, seq: list[str], into: str) -> None:
    """Rewrite the state as one batch in a new folder."""
    read_latest(spark, path, key, seq).write.mode("overwrite").parquet(f"{into}/batch_id=-1")


# ---------------------------------------------------------------------- alerts

def ledger_rows(alerts: DataFrame) -> DataFrame:
    """Alerts that passed the gate, in the columns of the permanent ledger."""
    return alerts.where(F.coalesce(F.col("passed_gate"), F.lit(False))).select(
        "entity_id", "predicted_phase", "dominant_signal", "narrative", "timestamp"
    )


def append_ledger(alerts: DataFrame, path: str) -> None:
    ledger_rows(alerts).write.mode("append").parquet(path)


def write_alert_lines(alerts: DataFrame, path: str, text=None, mode: str = "append") -> None:
    """Report lines by cloud and phase."""
    monitor.alert_lines(alerts, text).write.mode(mode).partitionBy("cloud", "phase").json(path)


def read_alert_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "job string, ts_us long, line string, cloud string, phase string"
    ).json(path)


def top_scored(df: DataFrame, n: int, score: str = "anomaly_score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), "event_id").limit(n)
