"""Queries over normalization and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from auditweave.functions import events, net
from auditweave.operators import enrich, normalize
from auditweave.plans.adapter import EV, audit_events
from auditweave.plans.encode import BAD_IP_K, BAD_TIME_K, TIED_K, encode
from auditweave.plans.registry import query
from auditweave.sources import files

SEVERITY = (
    "CASE WHEN {0} >= 4 THEN 'CRITICAL' WHEN {0} >= 3 THEN 'HIGH' WHEN {0} >= 2 THEN 'MEDIUM' "
    "ELSE 'LOW' END"
)


@query(
    "source_detection",
    f"""WITH {EV}
    SELECT event_id, CASE
      WHEN source_cloud = 'GCP' AND k = {TIED_K} THEN 'UNKNOWN'
      ELSE source_cloud END AS detected
    FROM ev""",
)
def source_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = encode(audit_events(spark, sf_dir))
    return raw.select(
        F.col("src_event_id").alias("event_id"),
        normalize.detect_source(F.col("raw")).alias("detected"),
    )


_PARSED = (
    "event_id", "ts_us", "source_cloud", "event_type", "user_id", "source_ip", "resource",
    "action", "status", "severity", "mfa_authenticated", "device_compliant_status",
    "account_type", "principal_type", "principal_key", "ua_family", "ua_version", "gt_principal",
)


def _parsed(spark: SparkSession, sf_dir: str, cloud: str) -> DataFrame:
    raw = encode(audit_events(spark, sf_dir), cloud).withColumn("cloud", F.lit(cloud))
    good, _ = normalize.normalize(raw, cloud_col="cloud")
    return good.select(
        F.col("src_event_id").alias("event_id"),
        events.micros(F.col("timestamp")).alias("ts_us"),
        *_PARSED[2:],
    )


_GOOD = f"k NOT IN ({BAD_TIME_K}, {BAD_IP_K})"
_ACCOUNT = (
    "CASE WHEN principal_type = 'IAMUser' THEN 'USER' WHEN principal_type = 'AssumedRole' "
    "THEN 'SERVICE' ELSE 'UNKNOWN' END"
)
AWS_SELECT = f"""SELECT event_id, t AS ts_us, 'AWS' AS source_cloud, 'AwsApiCall' AS event_type,
  concat('arn:aws:iam::112233445566:user/', principal) AS user_id, source_ip, resource, action,
  status, {SEVERITY.format('severity_score')} AS severity, k % 2 = 0 AS mfa_authenticated,
  CAST(NULL AS VARCHAR) AS device_compliant_status, {_ACCOUNT} AS account_type, principal_type,
  concat('arn:aws:iam::112233445566:user/', principal) AS principal_key, ua_family, ua_version,
  principal AS gt_principal
  FROM ev WHERE {_GOOD}"""
AZURE_SELECT = f"""SELECT event_id, t AS ts_us, 'AZURE' AS source_cloud,
  'SignInLogs' AS event_type,
  CASE WHEN principal_type = 'ServiceAccount' THEN principal
    ELSE concat(principal, '@corp.example') END AS user_id,
  source_ip, resource, action, status, {SEVERITY.format('severity_score')} AS severity,
  k % 2 = 0 AS mfa_authenticated,
  CASE k % 3 WHEN 1 THEN 'Compliant' WHEN 2 THEN 'NonCompliant' ELSE 'Unknown' END
    AS device_compliant_status,
  'UNKNOWN' AS account_type,
  CASE WHEN principal_type = 'ServiceAccount' THEN 'ServicePrincipal' ELSE 'User' END
    AS principal_type,
  CASE WHEN principal_type = 'ServiceAccount' THEN concat('app-', principal)
    ELSE concat(principal, '@corp.example') END AS principal_key,
  ua_family, ua_version, principal AS gt_principal
  FROM ev WHERE {_GOOD}"""
_EMAIL = (
    "CASE WHEN principal_type = 'ServiceAccount' THEN "
    "concat(principal, '@proj.iam.gserviceaccount.com') ELSE concat(principal, '@corp.example') END"
)
GCP_SELECT = f"""SELECT event_id, t AS ts_us, 'GCP' AS source_cloud, action AS event_type,
  {_EMAIL} AS user_id, source_ip, resource, action, status,
  {SEVERITY.format('(severity_score / 5.0 * 5)')} AS severity, false AS mfa_authenticated,
  CAST(NULL AS VARCHAR) AS device_compliant_status, 'UNKNOWN' AS account_type,
  CASE WHEN principal_type = 'ServiceAccount' THEN 'ServiceAccount' ELSE 'User' END
    AS principal_type,
  {_EMAIL} AS principal_key, ua_family, ua_version, principal AS gt_principal
  FROM ev WHERE {_GOOD}"""


@query("parse_aws", f"WITH {EV} {AWS_SELECT}")
def parse_aws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "AWS")


@query("parse_azure", f"WITH {EV} {AZURE_SELECT}")
def parse_azure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "AZURE")


@query("parse_gcp", f"WITH {EV} {GCP_SELECT}")
def parse_gcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "GCP")


@query(
    "normalize_mixed_clouds",
    f"""WITH {EV}
    SELECT * FROM ({AWS_SELECT} AND source_cloud = 'AWS')
    UNION ALL SELECT * FROM ({AZURE_SELECT} AND source_cloud = 'AZURE')
    UNION ALL SELECT * FROM ({GCP_SELECT} AND source_cloud = 'GCP' AND k <> {TIED_K})""",
)
def normalize_mixed_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = normalize.normalize(encode(audit_events(spark, sf_dir)))
    return good.select(
        F.col("src_event_id").alias("event_id"),
        events.micros(F.col("timestamp")).alias("ts_us"),
        *_PARSED[2:],
    )


_ERRORS = f"""CASE WHEN source_cloud = 'GCP' AND k = {TIED_K}
    THEN 'No parser configured or detected for cloud: UNKNOWN'
  WHEN k = {BAD_TIME_K} THEN 'Invalid timestamp format'
  WHEN k = {BAD_IP_K} THEN 'source_ip is not a valid IP address' END"""


@query(
    "dead_letters",
    f"""WITH {EV}, e AS (SELECT {_ERRORS} AS error FROM ev)
    SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY error""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dead = normalize.normalize(encode(audit_events(spark, sf_dir)))
    first_error = F.get(F.split("error", "; "), F.lit(0))
    return dead.groupBy(first_error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalization_counters",
    f"""WITH {EV}, e AS (SELECT {_ERRORS} AS error FROM ev)
    SELECT count(*) AS received, count(*) FILTER (WHERE error IS NULL) AS normalized,
      count(error) AS failed FROM e""",
)
def normalization_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.counters(normalize.parse(encode(audit_events(spark, sf_dir))))


@query(
    "timestamp_normalization",
    f"""WITH {EV}
    SELECT event_id, CASE k % 5 WHEN 0 THEN t // 1000000 * 1000000
      WHEN 1 THEN t // 1000000 * 1000000 - 7200000000
      WHEN 2 THEN t // 1000000 * 1000000
      WHEN 3 THEN t // 1000000 * 1000000 END AS ts_us
    FROM ev""",
)
def timestamp_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spellings of the event time: UTC, offset, naive, RFC 1123 style and nonsense."""
    ev = audit_events(spark, sf_dir)
    form = F.col("k") % 5

    def text(pattern: str):
        return F.date_format("timestamp", pattern)

    spelled = (
        F.when(form == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(form == 2, text("yyyy-MM-dd HH:mm:ss"))
        .when(form == 3, F.concat(F.lit("Mon, "), text("dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .otherwise("not a time")
    )
    return ev.select("event_id", events.micros(events.parse_time(spelled)).alias("ts_us"))


@query(
    "severity_buckets",
    f"""WITH {EV}
    SELECT {SEVERITY.format('severity_score')} AS severity, count(*) AS n
    FROM ev GROUP BY 1""",
)
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = events.severity_from_score(F.col("severity_score").cast("string"))
    return audit_events(spark, sf_dir).groupBy(severity.alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "user_agent_families",
    f"""WITH {EV} SELECT ua_family, ua_version, count(*) AS n FROM ev GROUP BY 1, 2""",
)
def user_agent_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).drop("ua_family", "ua_version")
    return enrich.enrich_user_agent(ev).groupBy("ua_family", "ua_version").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "principal_types_and_keys",
    f"""WITH {EV}, p AS (
      SELECT event_id, source_cloud, principal_type, principal_key FROM ({AWS_SELECT} AND source_cloud = 'AWS')
      UNION ALL SELECT event_id, source_cloud, principal_type, principal_key FROM ({AZURE_SELECT} AND source_cloud = 'AZURE')
      UNION ALL SELECT event_id, source_cloud, principal_type, principal_key
        FROM ({GCP_SELECT} AND source_cloud = 'GCP' AND k <> {TIED_K}))
    SELECT source_cloud, principal_type, count(*) AS n, count(DISTINCT principal_key) AS n_keys
    FROM p GROUP BY 1, 2""",
)
def principal_types_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = normalize.normalize(encode(audit_events(spark, sf_dir)))
    return good.groupBy("source_cloud", "principal_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("principal_key").alias("n_keys")
    )


_MADE_IPS = """CASE k % 8 WHEN 0 THEN concat('10.0.0.', k) WHEN 1 THEN concat('172.31.1.', k)
  WHEN 2 THEN concat('8.8.', k, '.1') WHEN 3 THEN concat('192.0.0.', k % 20)
  WHEN 4 THEN concat('2001:db8::', k) WHEN 5 THEN concat('2a00:1450::', k)
  WHEN 6 THEN concat('256.1.1.', k) ELSE concat('fe80::1:', k) END"""


@query(
    "ip_validation_and_ranges",
    f"""WITH {EV}
    SELECT event_id, k % 8 <> 6 AS valid,
      CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0
        WHEN 3 THEN CASE WHEN k % 20 IN (9, 10) THEN 0 ELSE 1 END
        WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN -1 ELSE 1 END AS internal
    FROM ev""",
)
def ip_validation_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.col("ip")
    made = audit_events(spark, sf_dir).select("event_id", F.expr(_MADE_IPS).alias("ip"))
    parsed = made.select(
        "event_id", net.is_ip(ip).alias("valid"),
        net.ipv4_long(ip).alias("v4"), F.when(ip.contains(":"), net.ip_key(ip)).alias("v6"),
    )
    return parsed.select(
        "event_id", "valid", net.internal_flag(F.col("v4"), F.col("v6")).alias("internal")
    )


@query(
    "ip_reputation_and_geo",
    f"""WITH {EV}
    SELECT event_id,
      (k % 11 = 0 OR (k // 10) % 4 = 1) AS is_known_proxy_or_tor,
      CASE (k // 10) % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN 'JP'
        ELSE CASE WHEN k < 60 THEN 'FR' ELSE 'Unknown' END END AS geo_country
    FROM ev""",
)
def ip_reputation_and_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit list and address ranges come from the addresses in the table; one range holds others."""
    ev = audit_events(spark, sf_dir).drop("is_known_proxy_or_tor")
    tor = ev.where(F.col("k") % 11 == 0).select(F.col("source_ip").alias("ip")).distinct()
    block = F.floor(F.col("k") / 10).cast("int")
    ranges = (
        ev.select(block.alias("b")).distinct().where(F.col("b") % 4 != 3).select(
            F.concat(F.lit("203.0.113."), F.col("b") * 10).alias("start_ip"),
            F.concat(F.lit("203.0.113."), F.col("b") * 10 + 9).alias("end_ip"),
            F.when(F.col("b") % 4 == 0, "DE").when(F.col("b") % 4 == 1, "US").otherwise("JP").alias("country"),
            F.when(F.col("b") % 4 == 1, "DigitalOcean LLC").otherwise("Home ISP").alias("asn_org"),
        )
    )
    around = ev.select(
        F.lit("203.0.113.0").alias("start_ip"), F.lit("203.0.113.59").alias("end_ip"),
        F.lit("FR").alias("country"), F.lit("Home ISP").alias("asn_org"),
    ).distinct()
    out = enrich.enrich_ip(ev, "source_ip", tor, ranges.unionByName(around))
    return out.select("event_id", "is_known_proxy_or_tor", "geo_country")


_CREATED = """SELECT event_id, coalesce(t - min(CASE WHEN action = 'CreateUser' AND
    source_cloud = 'AWS' THEN t END) OVER ({frame}) BETWEEN 0 AND 1800000000, false)
    AS principal_created_in_window FROM ev"""


@query(
    "created_in_window_live",
    f"""WITH {EV} {_CREATED.format(frame='PARTITION BY principal ORDER BY t, event_id '
        'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}""",
)
def created_in_window_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    return enrich.created_in_window(ev, key="principal").select(
        "event_id", "principal_created_in_window"
    )


@query(
    "created_in_window_batch",
    f"WITH {EV} {_CREATED.format(frame='PARTITION BY principal')}",
)
def created_in_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    return enrich.created_in_window(ev, key="principal", causal=False).select(
        "event_id", "principal_created_in_window"
    )


@query(
    "ground_truth_labels",
    f"""WITH {EV}
    SELECT principal AS gt_principal, is_attack, count(*) AS n FROM ev
    WHERE {_GOOD} AND NOT (source_cloud = 'GCP' AND k = {TIED_K})
    GROUP BY 1, 2""",
)
def ground_truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = normalize.normalize(encode(audit_events(spark, sf_dir)))
    return normalize.with_ground_truth(good).groupBy("gt_principal", "is_attack").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "bridge_normalized_rows",
    f"""WITH {EV}
    SELECT event_id, CASE WHEN k % 2 = 0 THEN concat('alias_', k) ELSE principal END AS principal,
      t AS ts_us, source_ip FROM ev""",
)
def bridge_normalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir)
    alias = F.when(F.col("k") % 2 == 0, F.concat(F.lit("alias_"), "k"))
    rows = ev.select(
        "event_id", "user_id", alias.alias("principal"), "source_ip",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
    )
    return normalize.bridge(rows).select(
        "event_id", "principal", events.micros(F.col("timestamp")).alias("ts_us"), "source_ip"
    )


_AFTER_ALL = 4_000_000_000_000_000  # microseconds, later than any event; exact in a double


@query(
    "merge_sources_by_time",
    f"""WITH {EV}
    SELECT event_id, row_number() OVER (
      ORDER BY CASE WHEN k <> {BAD_TIME_K} THEN t END NULLS LAST, event_id) AS position FROM ev""",
)
def merge_sources_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers' records in one event-time order; positions show that order.

    Records of one time follow by their ids, and so do those whose time cannot be read, at the end.
    """
    from auditweave.operators import ordered

    ev = audit_events(spark, sf_dir)
    parts = [encode(ev.where(F.col("source_cloud") == c), c) for c in files.CLOUDS]
    merged = files.merge_sources(*parts)
    at = merged.select(
        F.col("src_event_id").alias("event_id"),
        F.coalesce(events.micros(events.parse_time(F.col("event_time"))), _AFTER_ALL + F.col("src_event_id"))
        .cast("double").alias("at"),
        F.lit(1).alias("one"),
    )
    per_time = at.groupBy("at").agg(F.sum("one").alias("n"))
    before = ordered.global_prefix(per_time, "at", {"upto": "n"})
    placed = at.join(before.withColumnRenamed("at", "__at"), F.col("at") == F.col("__at"))
    among_ties = F.row_number().over(Window.partitionBy("at").orderBy("event_id"))
    return placed.select(
        "event_id", (F.col("upto") - F.col("n") + among_ties).cast("long").alias("position")
    )
