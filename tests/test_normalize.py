"""Hand-made provider records through detection, parsing, validation and enrichment."""

import json

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from auditweave.functions import agents, events, net
from auditweave.operators import enrich, normalize

AWS = {
    "eventVersion": "1.08", "awsRegion": "us-east-1", "eventID": "a1",
    "userIdentity": {"type": "IAMUser", "principalId": "P1", "arn": "arn:aws:iam::1:user/ann", "userName": "ann"},
    "eventTime": "2026-06-10T08:14:32Z", "eventName": "ConsoleLogin", "eventType": "AwsConsoleSignIn",
    "sourceIPAddress": "203.0.113.45", "userAgent": "aws-cli/2.1.0 Python",
    "requestParameters": None, "additionalEventData": {"MFAUsed": "YES"},
    "ml_labels": {"anomaly_flag": False, "threat_category": "Normal", "severity_score": 3.2},
}
AZURE = {
    "time": "2026-06-10T10:14:32+02:00", "category": "SignInLogs", "operationName": "Sign-in activity",
    "resultType": "0", "callerIpAddress": "not-an-ip", "tenantId": "t",
    "properties": {
        "id": "z1", "userPrincipalName": "ann@corp.example", "userAgent": "Mozilla Chrome/120.0",
        "deviceDetail": {"isCompliant": False}, "mfaDetail": {"authMethod": "Phone"},
    },
}
GCP = {
    "insertId": "g1", "logName": "l", "timestamp": "2026-06-10T08:14:32.5Z",
    "protoPayload": {
        "methodName": "SetIamPolicy", "resourceName": "projects/p",
        "authenticationInfo": {"principalEmail": "bot@p.iam.gserviceaccount.com"},
        "requestMetadata": {"callerIp": "2001:db8::7", "callerSuppliedUserAgent": "google-cloud-sdk/471.0.0"},
        "status": {"code": 7},
    },
    "ml_labels": {"severity_score": 0.7, "threat_category": "Impact"},
}


def load(spark, *records):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return spark.createDataFrame(texts, "raw string")


def parsed(spark, *records):
    return rows(normalize.parse(load(spark, *records)).drop("raw_log"))


def test_three_clouds(spark):
    good, dead = normalize.normalize(load(spark, AWS, AZURE, GCP))
    got = by(good.drop("raw_log"), "event_id")
    assert dead.count() == 0
    a, z, g = got["a1"], got["z1"], got["g1"]
    assert (a["source_cloud"], a["account_type"], a["severity"], a["mfa_authenticated"]) == ("AWS", "USER", "HIGH", True)
    assert (a["user_id"], a["resource"], a["status"]) == ("arn:aws:iam::1:user/ann", "None", "SUCCESS")
    assert (a["ua_family"], a["ua_version"], a["gt_principal"]) == ("aws-cli", "2.1.0", "ann")
    assert z["timestamp"] == a["timestamp"]
    assert (z["device_compliant_status"], z["source_ip"], z["resource"]) == ("NonCompliant", None, "Unknown")
    assert (z["principal_type"], z["gt_principal"], z["severity"]) == ("User", "ann", "LOW")
    assert (g["status"], g["severity"], g["principal_type"]) == ("FAILED", "HIGH", "ServiceAccount")
    assert (g["source_ip"], g["threat_category"], g["gt_principal"]) == ("2001:db8::7", "Impact", "bot")


def test_sample_traps(spark):
    wrapped = {"source": "AWS", "payload": {"eventTime": "2026-06-25T14:30:00Z"}}
    azure_bad_caller = {**AZURE, "callerIpAddress": "Not-An-IP-Address"}
    no_time = {k: v for k, v in GCP.items() if k != "timestamp"}
    bad_ip = json.loads(json.dumps(GCP))
    bad_ip["protoPayload"]["requestMetadata"]["callerIp"] = "999.999.999.999"
    got = parsed(spark, wrapped, azure_bad_caller, no_time, bad_ip, "{broken")
    assert "UNKNOWN" in got[0]["error"]
    assert got[1]["error"] is None
    assert got[2]["error"] == "Invalid timestamp format"
    assert got[3]["error"] == "source_ip is not a valid IP address"
    assert got[4]["error"] is not None


def test_missing_null_and_wrong_types(spark):
    no_result = {k: v for k, v in AZURE.items() if k != "resultType"}
    null_arn = json.loads(json.dumps(AWS))
    null_arn["userIdentity"]["arn"] = None
    number_action = {**AWS, "eventName": 5}
    null_identity = {**AWS, "userIdentity": None}
    no_arn = json.loads(json.dumps(AWS))
    del no_arn["userIdentity"]["arn"]
    failed = {**{k: v for k, v in AWS.items() if k != "ml_labels"}, "errorCode": "AccessDenied"}
    object_action = {**AZURE, "operationName": {"value": "Add user"}}
    got = parsed(spark, no_result, null_arn, number_action, null_identity, no_arn, failed, object_action)
    assert got[0]["status"] == "FAILED"
    assert "user_id" in got[1]["error"]
    assert "action" in got[2]["error"]
    assert "field type" in got[3]["error"]
    assert got[4]["user_id"] == "P1"
    assert (got[5]["status"], got[5]["severity"], got[5]["threat_category"]) == ("FAILED", "HIGH", "Normal")
    assert got[6]["action"] == "Add user"


def test_detection_counts_null_keys_and_ties(spark):
    tie = {"eventVersion": None, "insertId": None}
    only_null = {"awsRegion": None}
    got = [r[0] for r in load(spark, tie, only_null, {}).select(normalize.detect_source(F.col("raw"))).collect()]
    assert got == ["UNKNOWN", "AWS", "UNKNOWN"]


def test_counters_and_observation(spark):
    frame = normalize.parse(load(spark, AWS, {"x": 1}))
    assert rows(normalize.counters(frame)) == [{"received": 2, "normalized": 1, "failed": 1}]
    watched, watch = normalize.observed(frame)
    watched.select("event_id", "error").collect()
    assert watch.get == {"received": 2, "normalized": 1, "failed": 1}


@pytest.mark.parametrize(
    ("ip", "valid", "flag"),
    [
        ("10.1.2.3", True, 1), ("8.8.8.8", True, 0), ("203.0.113.9", True, 1), ("192.0.0.9", True, 0),
        ("01.2.3.4", False, -1), ("1.2.3", False, -1), ("", False, -1), ("::1", True, 1),
        ("2a00:1450::1", True, 0), ("2001:db8::1", True, 1), ("fe80::1:2", True, 1), ("1::2::3", False, -1),
        ("::ffff:10.0.0.1", True, 1), ("2001:4:112::1", True, 0), (None, False, -1), ("100.64.0.1", True, 0),
    ],
)
def test_addresses(spark, ip, valid, flag):
    frame = spark.createDataFrame([(ip,)], "ip string")
    c = F.col("ip")
    got = frame.select(net.is_ip(c), net.ipv4_long(c).alias("a"), F.when(c.contains(":"), net.ip_key(c)).alias("b"))
    row = got.select("*", net.internal_flag(F.col("a"), F.col("b"))).first()
    assert (row[0], row[3]) == (valid, flag)


def test_user_agents(spark):
    cases = {
        "": ("Unknown", "Unknown"), None: ("Unknown", "Unknown"), "weird": ("Other", "Unknown"),
        "x Chrome/1.2 Safari/3": ("Chrome", "1.2"), "Boto3/1.9 aws-cli/2.0": ("aws-cli", "2.0"),
        "Go-http-client/1.1": ("Go-http-client", "1.1"),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "ua string")
    got = frame.select(agents.ua_family(F.col("ua")), agents.ua_version(F.col("ua"), agents.ua_family(F.col("ua")))).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def test_times(spark):
    cases = ["2026-06-10T08:14:32Z", "2026-06-10 08:14:32", "2026-06-10T10:14:32+02:00",
             "Wed, 10 Jun 2026 08:14:32 GMT", "06/10/2026 08:14:32", "20260610T081432Z"]
    frame = spark.createDataFrame([(c,) for c in [*cases, "", "soon", None]], "t string")
    got = [r[0] for r in frame.select(events.micros(events.parse_time(F.col("t")))).collect()]
    assert len(set(got[:6])) == 1 and got[0] is not None
    assert got[6:] == [None, None, None]


def test_reputation_is_tri_state(spark):
    frame = spark.createDataFrame([("1.2.3.4",), ("5.6.7.8",), (None,), ("9.9.9.9",)], "source_ip string")
    nothing = [r[1] for r in enrich.enrich_ip(frame).select("source_ip", "is_known_proxy_or_tor").collect()]
    assert nothing == [None] * 4
    tor = spark.createDataFrame([("1.2.3.4",)], "ip string")
    ranges = spark.createDataFrame(
        [("5.6.0.0", "5.6.255.255", "FR", "OVH SAS"), ("9.9.9.0", "9.9.9.255", "CH", "Quad")],
        "start_ip string, end_ip string, country string, asn_org string",
    )
    for limit in (1_000_000, 0):
        out = enrich.join_ip_ranges(frame, "source_ip", ranges, ["country"], max_broadcast=limit)
        assert {r["source_ip"]: r["country"] for r in out.collect()} == {
            "1.2.3.4": None, "5.6.7.8": "FR", None: None, "9.9.9.9": "CH"}
    got = {r["source_ip"]: (r["is_known_proxy_or_tor"], r["geo_country"])
           for r in enrich.enrich_ip(frame, "source_ip", tor, ranges).collect()}
    assert got == {"1.2.3.4": (True, "Unknown"), "5.6.7.8": (True, "FR"), None: (False, "Unknown"),
                   "9.9.9.9": (False, "CH")}


def test_ranges_with_odd_borders_and_both_families(spark):
    ranges = spark.createDataFrame(
        [("1.0.0.200", "1.0.1.10", "A"), ("1.0.1.11", "1.0.255.255", "B"), ("2001:db8::", "2001:db8::ff", "C")],
        "start_ip string, end_ip string, country string",
    )
    ips = ["1.0.0.199", "1.0.0.200", "1.0.1.10", "1.0.1.11", "1.0.200.1", "2001:db8::fe", "2001:db8::100"]
    frame = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["country"] for r in enrich.join_ip_ranges(frame, "ip", ranges, ["country"]).collect()}
    assert [got[i] for i in ips] == [None, "A", "A", "B", "B", "C", None]


def test_nested_ranges_keep_one_row_per_event(spark):
    ranges = spark.createDataFrame(
        [("8.8.0.0", "8.8.255.255", "A"), ("8.8.0.0", "8.8.200.255", "B"), ("8.8.4.0", "8.8.4.255", "C"),
         ("8.8.4.0", "8.8.4.255", "D")],
        "start_ip string, end_ip string, country string",
    )
    ips = ["8.8.250.1", "8.8.1.1", "8.8.4.4", "8.8.4.4", "9.9.9.9", None]
    frame = spark.createDataFrame(list(enumerate(ips)), "event_id int, ip string")
    for limit in (1_000_000, 0):
        out = enrich.join_ip_ranges(frame, "ip", ranges, ["country"], max_broadcast=limit).collect()
        assert sorted((r["event_id"], r["country"]) for r in out) == [
            (0, "A"), (1, "B"), (2, "C"), (3, "C"), (4, None), (5, None)]


def test_typed_parse_equals_field_by_field(spark, monkeypatch):
    """Odd types, nulls, duplicates and trailing text must not depend on which way a record is read."""
    import json

    odd = [
        AWS | {"userIdentity": None}, AWS | {"userIdentity": "x"}, AWS | {"userIdentity": {"type": 5, "arn": None}}, AWS | {"eventName": 7},
        AWS | {"resources": []}, AWS | {"resources": {"ARN": "x"}}, AWS | {"resources": [None]}, AWS | {"resources": [{"ARN": 3}]},
        AWS | {"errorCode": ""}, AWS | {"errorCode": {"a": 1}}, AWS | {"ml_labels": None}, AWS | {"ml_labels": {"severity_score": "3.5"}},
        AWS | {"additionalEventData": None}, AWS | {"note": "\"properties\" and \"status\""}, AWS | {"sourceIPAddress": 12},
        AZURE | {"properties": None}, AZURE | {"operationName": {"value": "Add user"}}, AZURE | {"operationName": {"other": 1}}, AZURE | {"operationName": None},
        AZURE | {"properties": AZURE["properties"] | {"mfaDetail": {}}}, AZURE | {"properties": AZURE["properties"] | {"mfaDetail": {"x": 0}}},
        AZURE | {"properties": AZURE["properties"] | {"targetResources": [{"displayName": "", "id": 4}]}},
        AZURE | {"properties": AZURE["properties"] | {"deviceDetail": {"isCompliant": "true"}}},
        GCP | {"protoPayload": GCP["protoPayload"] | {"status": None}}, GCP | {"protoPayload": GCP["protoPayload"] | {"status": {"code": "0"}}},
        GCP | {"protoPayload": GCP["protoPayload"] | {"requestMetadata": [1]}}, GCP | {"protoPayload": None}, GCP | {"ml_labels": {"severity_score": None}},
    ]
    texts = [json.dumps(r) for r in odd] + [json.dumps(AWS) + " tail", json.dumps(AWS)[:-1] + ', "eventID": "twice"}', "[]", "", "null"]
    frame = spark.createDataFrame([(t,) for t in texts], "raw string")
    shown = [c for c in normalize.parse(frame).columns if c not in ("raw_log",)]

    def run():
        normalize._record.cache_clear()
        return sorted(map(str, normalize.parse(frame).select(*shown).collect()))

    typed = run()
    monkeypatch.setattr(normalize.TypedRecord, "unsure", staticmethod(lambda t, raw: F.lit(True)))
    try:
        assert typed == run()
    finally:
        normalize._record.cache_clear()
