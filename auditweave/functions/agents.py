"""User-agent and principal-type expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (pattern, family), first hit wins.
UA_RULES = (
    (r"aws-cli/([\d.]+)", "aws-cli"),
    (r"aws-sdk-go/([\d.]+)", "aws-sdk-go"),
    (r"Boto3/([\d.]+)", "Boto3"),
    (r"azure-cli/([\d.]+)", "azure-cli"),
    (r"Terraform/([\d.]+)", "Terraform"),
    (r"google-cloud-sdk/([\d.]+)", "google-cloud-sdk"),
    (r"Chrome/([\d.]+)", "Chrome"),
    (r"Firefox/([\d.]+)", "Firefox"),
    (r"Safari/([\d.]+)", "Safari"),
    (r"curl/([\d.]+)", "curl"),
    (r"python-requests/([\d.]+)", "python-requests"),
    (r"python-urllib3/([\d.]+)", "python-urllib3"),
    (r"Go-http-client/([\d.]+)", "Go-http-client"),
)
BROWSERS = ("Chrome", "Firefox", "Safari")
SYSTEMS = ("Windows", "Mac", "Linux")

# Principal types grouped for stitching.
STITCH_AUTOMATION_TYPES = (
    "ASSUMEDROLE", "SERVICEACCOUNT", "SERVICEPRINCIPAL", "ROLE", "AWSSERVICE", "AWSACCOUNT",
)
STITCH_HUMAN_TYPES = ("IAMUSER", "USER", "ROOT", "FEDERATEDUSER")

# Principal types and user-agent hints that risk scoring reads as automation.
RISK_AUTOMATION_TYPES = (
    "SERVICEACCOUNT", "ASSUMEDROLE", "ROLE", "FEDERATEDUSER", "AWSSERVICE", "AWSACCOUNT",
)
RISK_AUTOMATION_HINTS = (
    "boto", "aws-cli", "aws-sdk", "terraform", "botocore", "azure-sdk", "azure-cli",
    "google-api", "gcloud", "kubectl", "curl", "powershell", "python-requests", "go-http",
    "okhttp",
)


def ua_family(ua: Column) -> Column:
    hit = F.when(ua.isNull() | (ua == ""), "Unknown")
    for pattern, family in UA_RULES:
        hit = hit.when(ua.rlike(pattern), family)
    return hit.otherwise("Other")


def ua_version(ua: Column, family: Column) -> Column:
    """Version that belongs to an already found family."""
    hit = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in UA_RULES:
        hit = hit.when(family == name, F.regexp_extract(ua, pattern, 1))
    return hit.otherwise("Unknown")


def first_contained(text: Column, words: tuple[str, ...], default: str = "Unknown") -> Column:
    hit = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in words:
        hit = hit.when(text.contains(word), word)
    return hit.otherwise(default)


def stitch_class(principal_type: Column) -> Column:
    """'human', 'automation' or NULL (unrecognized)."""
    kind = F.upper(principal_type)
    return F.when(kind.isin(*STITCH_AUTOMATION_TYPES), "automation").when(
        kind.isin(*STITCH_HUMAN_TYPES), "human"
    )


def automation_hint(ua: Column) -> Column:
    text = F.lower(F.coalesce(ua, F.lit("")))
    hit = F.lit(False)
    for word in RISK_AUTOMATION_HINTS:
        hit = hit | text.contains(word)
    return hit
