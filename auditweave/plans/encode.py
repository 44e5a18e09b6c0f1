"""Provider records as JSON text, written from the adapter's columns.

Encoding and parsing back lets SQL compute the expected columns straight from the
table. A few values of ``k`` make damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.session import spread

BAD_TIME_K, BAD_IP_K, NO_SIGNATURE_K, TIED_K = 13, 17, 19, 23
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _time() -> Column:
    return F.when(F.col("k") == BAD_TIME_K, "yesterday-ish").otherwise(
        F.date_format("timestamp", ISO)
    )


def _ip() -> Column:
    return F.when(F.col("k") == BAD_IP_K, "999.1.2.3").otherwise(F.col("source_ip"))


def _labels() -> Column:
    return F.struct(
        (F.col("is_attack") == 1).alias("anomaly_flag"), "threat_category", "severity_score"
    )


def aws_record() -> Column:
    failed = F.col("status") == "FAILED"
    return F.to_json(
        F.struct(
            F.when(F.col("k") != NO_SIGNATURE_K, "1.08").alias("eventVersion"),
            F.struct(
                F.col("principal_type").alias("type"),
                F.concat(F.lit("arn:aws:iam::112233445566:user/"), "principal").alias("arn"),
                F.col("principal").alias("userName"),
            ).alias("userIdentity"),
            _time().alias("eventTime"),
            F.lit("iam.amazonaws.com").alias("eventSource"),
            F.col("action").alias("eventName"),
            F.lit("us-east-1").alias("awsRegion"),
            _ip().alias("sourceIPAddress"),
            F.col("user_agent").alias("userAgent"),
            F.when(failed, "AccessDenied").alias("errorCode"),
            F.struct(F.when(F.col("k") % 2 == 0, "Yes").otherwise("No").alias("MFAUsed")).alias(
                "additionalEventData"
            ),
            F.array(F.struct(F.col("resource").alias("ARN"))).alias("resources"),
            F.col("event_id").cast("string").alias("eventID"),
            F.lit("AwsApiCall").alias("eventType"),
            _labels().alias("ml_labels"),
        )
    )


def azure_record() -> Column:
    service = F.col("principal_type") == "ServiceAccount"
    upn = F.concat("principal", F.lit("@corp.example"))
    result = F.when(F.col("status") == "FAILED", "50126").when(F.col("k") % 2 == 0, "0").otherwise(
        "Success"
    )
    return F.to_json(
        F.struct(
            _time().alias("time"),
            F.lit("SignInLogs").alias("category"),
            F.struct(F.col("action").alias("value")).alias("operationName"),
            result.alias("resultType"),
            F.lit("198.51.100.7").alias("callerIpAddress"),
            F.lit("tenant-1").alias("tenantId"),
            F.struct(
                F.col("event_id").cast("string").alias("id"),
                F.when(~service, upn).alias("userPrincipalName"),
                F.when(service, F.col("principal")).alias("servicePrincipalName"),
                F.when(service, F.concat(F.lit("app-"), "principal")).alias("appId"),
                _ip().alias("ipAddress"),
                F.col("user_agent").alias("userAgent"),
                F.when(
                    F.col("k") % 3 != 0, F.struct((F.col("k") % 3 == 1).alias("isCompliant"))
                ).alias("deviceDetail"),
                F.when(F.col("k") % 2 == 0, F.struct(F.lit("Phone").alias("authMethod"))).alias(
                    "mfaDetail"
                ),
                F.array(F.struct(F.col("resource").alias("displayName"))).alias("targetResources"),
            ).alias("properties"),
            _labels().alias("ml_labels"),
        )
    )


def gcp_record() -> Column:
    email = F.when(
        F.col("principal_type") == "ServiceAccount",
        F.concat("principal", F.lit("@proj.iam.gserviceaccount.com")),
    ).otherwise(F.concat("principal", F.lit("@corp.example")))
    return F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("insertId"),
            F.lit("projects/p/logs/activity").alias("logName"),
            _time().alias("timestamp"),
            F.when(F.col("k") == TIED_K, "tenant-1").alias("tenantId"),
            F.when(F.col("k") == TIED_K, "audit").alias("category"),
            F.when(F.col("k") == TIED_K, "c-1").alias("correlationId"),
            F.struct(
                F.col("action").alias("methodName"),
                F.col("resource").alias("resourceName"),
                F.struct(email.alias("principalEmail")).alias("authenticationInfo"),
                F.struct(
                    _ip().alias("callerIp"), F.col("user_agent").alias("callerSuppliedUserAgent")
                ).alias("requestMetadata"),
                F.when(F.col("status") == "FAILED", F.struct(F.lit(7).alias("code"))).alias("status"),
            ).alias("protoPayload"),
            F.struct(
                (F.col("is_attack") == 1).alias("anomaly_flag"), "threat_category",
                (F.col("severity_score") / 5.0).alias("severity_score"),
            ).alias("ml_labels"),
        )
    )


def encode(events: DataFrame, cloud: str | None = None) -> DataFrame:
    """(event_id, raw): each event as its own cloud's record, or all as one cloud's."""
    makers = {"AWS": aws_record, "AZURE": azure_record, "GCP": gcp_record}
    if cloud:
        raw = makers[cloud]()
    else:
        raw = F.when(F.col("source_cloud") == "AWS", aws_record()).when(
            F.col("source_cloud") == "AZURE", azure_record()
        ).otherwise(gcp_record())
    return spread(events).select(F.col("event_id").alias("src_event_id"), raw.alias("raw"))
