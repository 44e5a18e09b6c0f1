"""Small expressions over event fields: clouds, times, severities, sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000

# Actions with a sensitivity other than the default 1.
ACTION_SENSITIVITY = {
    "ConsoleLogin": 1,
    "Sign-in activity": 1,
    "SetIamPolicy": 4,
    "DeleteBucket": 3,
    "CreateUser": 4,
    "DescribeInstances": 1,
}
# Severity text to number.
SEVERITY_CODES = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
READ_PATTERN = "(?i)Get|List|Describe|Read"
SERVICE_PATTERN = "svc|role|arn:|service"

# Accepted besides ISO-8601.
EXTRA_TIME_FORMATS = (
    "dd MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyyMMdd'T'HHmmssX",
    "yyyyMMddHHmmss",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def micros(ts: Column) -> Column:
    """Event time as UTC epoch microseconds (takes TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_time(text: Column) -> Column:
    """UTC timestamp, or NULL. Naive text counts as UTC, offsets are applied."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(text).try_cast("timestamp"))
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", "")
    options = [F.try_to_timestamp(plain, F.lit(fmt)) for fmt in EXTRA_TIME_FORMATS]
    return F.coalesce(iso, *options)


def severity_from_score(score: Column) -> Column:
    number = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return (
        F.when(number >= 4, "CRITICAL").when(number >= 3, "HIGH").when(number >= 2, "MEDIUM")
        .otherwise("LOW")
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    value = F.try_element_at(F.create_map(*pairs), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def normalize_cloud(cloud: Column) -> Column:
    """Upper case; Entra ID counts as Azure; missing is UNKNOWN."""
    name = F.upper(F.coalesce(F.nullif(cloud, F.lit("")), F.lit("UNKNOWN")))
    return F.when(name == "ENTRA-ID", "AZURE").otherwise(name)


def first_text(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def is_attack(category: Column) -> Column:
    return ~F.coalesce(category, F.lit("")).isin("", "Normal")


def safe_ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def finite(value: Column, default: float) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.lit(float(default))).otherwise(number)
