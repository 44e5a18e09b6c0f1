"""Feature engineering: per-event columns, trailing windows per user, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.functions import agents, events, net
from auditweave.operators import ordered
from auditweave.operators.ordered import TrailingDistinct, TrailingSum

MINUTE, HOUR, DAY = 60, 3600, 86400

TARGETS = (
    "severity", "severity_score", "threat_category", "anomaly_flag", "trust_score", "risk_score",
)
BASE_FEATURES = (
    "source_cloud", "action", "mfa_authenticated", "account_type", "principal_type",
    "principal_created_in_window", "ua_family", "ua_version", "hour_of_day", "day_of_week",
    "is_weekend", "is_night_access", "is_business_hour", "user_type_is_service", "os_type",
    "action_sensitivity_score", "login_result_success", "is_new_device_for_user",
    "api_call_count_1m", "error_rate_5m", "read_vs_write_ratio", "unique_resources_accessed",
    "unique_ips_last_24h", "privileged_actions_last_24h",
)
LABELED_ONLY_FEATURES = (
    "device_compliant_status", "geo_country", "is_known_proxy_or_tor", "is_internal_ip",
)
# Text columns that are encoded where they are among the features.
CATEGORICAL = (
    "source_cloud", "action", "user_id", "device_compliant_status", "browser_type", "os_type", "geo_country",
    "account_type", "principal_type", "is_known_proxy_or_tor", "ua_family", "ua_version",
)


def feature_columns(labeled: bool = False) -> list[str]:
    """24 columns, or 28 with the four that only vary on labeled data."""
    return [*BASE_FEATURES, *(LABELED_ONLY_FEATURES if labeled else ())]


def _or(df: DataFrame, name: str, default, kind: str) -> Column:
    if name not in df.columns:
        return F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))


def temporal(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    hour, day = F.hour(F.col(ts).cast("timestamp")), F.weekday(F.col(ts).cast("timestamp"))
    return df.withColumns(
        {
            "hour_of_day": hour,
            "day_of_week": day,
            "is_weekend": F.when(day >= 5, 1).otherwise(0),
            "is_night_access": F.when((hour < 6) | (hour >= 22), 1).otherwise(0),
            "is_business_hour": F.when(hour.between(8, 18), 1).otherwise(0),
        }
    )


def identity_and_network(df: DataFrame) -> DataFrame:
    agent = _or(df, "user_agent", "Unknown", "string")
    proxy = (
        F.when(F.col("is_known_proxy_or_tor"), "True").when(
            ~F.col("is_known_proxy_or_tor"), "False"
        ).otherwise("Unknown")
        if "is_known_proxy_or_tor" in df.columns
        else F.lit("Unknown")
    )
    ip = F.col("source_ip") if "source_ip" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "mfa_authenticated": _or(df, "mfa_authenticated", 0, "int"),
            "principal_created_in_window": _or(df, "principal_created_in_window", 0, "int"),
            "user_type_is_service": F.coalesce(
                F.lower(F.col("user_id").cast("string")).rlike(events.SERVICE_PATTERN).cast("int"),
                F.lit(0),
            ),
            "account_type": _or(df, "account_type", "UNKNOWN", "string"),
            "principal_type": _or(df, "principal_type", "Unknown", "string"),
            "is_known_proxy_or_tor": proxy,
            "ua_family": _or(df, "ua_family", "Unknown", "string"),
            "ua_version": _or(df, "ua_version", "Unknown", "string"),
            "device_compliant_status": _or(df, "device_compliant_status", "Unknown", "string"),
            "geo_country": _or(df, "geo_country", "Unknown", "string"),
            "browser_type": agents.first_contained(agent, agents.BROWSERS),
            "os_type": agents.first_contained(agent, agents.SYSTEMS),
            "__v4": net.ipv4_long(ip),
            "__v6": F.when(ip.contains(":"), net.ip_key(ip)),
        }
    ).withColumn("is_internal_ip", net.internal_flag(F.col("__v4"), F.col("__v6"))).drop(
        "__v4", "__v6"
    )


def action_features(df: DataFrame) -> DataFrame:
    read = F.coalesce(F.col("action").rlike(events.READ_PATTERN), F.lit(False))
    return df.withColumns(
        {
            "action_sensitivity_score": events.lookup(F.col("action"), events.ACTION_SENSITIVITY, 1),
            "login_result_success": F.when(F.col("status") == "SUCCESS", 1).otherwise(0),
            "is_read_action": read.cast("int"),
        }
    )


def behaviour(
    df: DataFrame,
    ts: str = "timestamp",
    order: str = "event_id",
    *,
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """First-occurrence flags and trailing windows (t - W, t] per user.

    Rows of one user at the same time see each other. Needs ``browser_type``,
    ``os_type``, ``action_sensitivity_score``, ``login_result_success``, ``is_read_action``.
    """
    kept = df.columns
    base = df.withColumn("__t", events.micros(F.col(ts)))
    sliced = ordered.with_slices(base, ["user_id"], "__t", hot_rows, slice_us)
    marked = ordered.mark_first(
        sliced, "__t", [order],
        {
            "is_new_ip_for_user": ["source_ip"],
            "is_new_device_for_user": ["browser_type", "os_type"],
        },
    )
    one, read = F.lit(1), F.col("is_read_action")
    windows = ordered.trailing(
        marked, "__t", [order],
        {
            "api_call_count_1m": TrailingSum(MINUTE, one),
            "failed_actions_5m": TrailingSum(5 * MINUTE, 1 - F.col("login_result_success")),
            "total_actions_5m": TrailingSum(5 * MINUTE, one),
            "reads_1h": TrailingSum(HOUR, read),
            "writes_1h": TrailingSum(HOUR, 1 - read),
            "privileged_actions_last_24h": TrailingSum(
                DAY, (F.col("action_sensitivity_score") >= 3).cast("int")
            ),
        },
        {
            "unique_resources_accessed": TrailingDistinct(DAY, "resource"),
            "unique_ips_last_24h": TrailingDistinct(DAY, "source_ip"),
        },
    )
    return windows.select(
        *kept,
        F.col("is_new_ip_for_user").cast("int").alias("is_new_ip_for_user"),
        F.col("is_new_device_for_user").cast("int").alias("is_new_device_for_user"),
        "api_call_count_1m",
        (F.col("failed_actions_5m") / F.col("total_actions_5m")).alias("error_rate_5m"),
        (F.col("reads_1h") / F.greatest(F.col("writes_1h"), F.lit(1))).alias("read_vs_write_ratio"),
        "unique_resources_accessed",
        "unique_ips_last_24h",
        "privileged_actions_last_24h",
    )


def features(df: DataFrame, ts: str = "timestamp", order: str = "event_id", **skew) -> DataFrame:
    """All feature columns, raw text still in place; labels and keys stay in the row."""
    prepared = action_features(identity_and_network(temporal(df, ts)))
    return behaviour(prepared, ts, order, **skew)


def split_features(df: DataFrame, labeled: bool = False, keys: tuple[str, ...] = ("event_id",)):
    """(X, y): feature columns only, and the targets, both with the keys."""
    wanted = feature_columns(labeled)
    leaked = set(wanted) & set(TARGETS)
    if leaked:
        raise ValueError(f"targets among the features: {sorted(leaked)}")
    targets = [c for c in TARGETS if c in df.columns]
    y = df.select(*keys, *targets)
    if "severity" in targets:
        y = y.withColumn("severity", events.lookup(F.col("severity"), events.SEVERITY_CODES, 0))
    return df.select(*keys, *wanted), y


def fit_encoder(df: DataFrame, labeled: bool = False, also: Sequence[str] = ()) -> PipelineModel:
    """Alphabetical codes per text column (unseen values get one code at the end) + vector.

    ``also`` keeps further columns, such as ``user_id`` and ``browser_type``.
    """
    wanted = [*feature_columns(labeled), *also]
    texts = [c for c in CATEGORICAL if c in wanted]
    indexer = StringIndexer(
        inputCols=texts,
        outputCols=[f"{c}__code" for c in texts],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    # Codes enter the model as plain numbers, not as categories of a tree.
    numbers = ", ".join(f"{c}__code + 0.0D AS {c}__num" for c in texts)
    plain = SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")
    assembler = VectorAssembler(
        inputCols=[f"{c}__num" if c in texts else c for c in wanted], outputCol="features"
    )
    return Pipeline(stages=[indexer, plain, assembler]).fit(df)


def encode(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def export_features(df: DataFrame, path_x: str, path_y: str, labeled: bool = False) -> None:
    """Write the feature matrix and the targets as CSV folders."""
    x, y = split_features(df, labeled)
    x.write.mode("overwrite").option("header", True).csv(path_x)
    y.write.mode("overwrite").option("header", True).csv(path_y)
