"""Raw provider records to unified events, with a dead-letter table."""

from __future__ import annotations

from functools import cache, lru_cache, reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from auditweave.functions import agents, events, net

# Top-level keys that give a provider away.
SIGNATURES = {
    "AWS": ("eventVersion", "userIdentity", "awsRegion", "eventID"),
    "AZURE": ("callerIpAddress", "category", "correlationId", "tenantId"),
    "GCP": ("protoPayload", "insertId", "logName", "receiveTimestamp"),
}
# Identity and action names.
AWS_USER_TYPES = ("IAMUser", "Root", "IdentityCenterUser", "FederatedUser", "SAMLUser")
AWS_SERVICE_TYPES = ("AssumedRole", "Role", "AWSService")
CREATION_ACTIONS = {
    "AWS": ("CreateUser", "CreateRole", "CreateAccessKey"),
    "AZURE": ("Add user", "Add service principal", "Add application"),
    "GCP": ("google.iam.admin.v1.CreateServiceAccount",),
}
GCP_SERVICE_SUFFIX = ".iam.gserviceaccount.com"

REQUIRED = ("event_type", "user_id", "resource", "action", "status", "severity")
UNIFIED_COLUMNS = (
    "event_id", "timestamp", "source_cloud", "event_type", "user_id", "source_ip",
    "destination_ip", "resource", "action", "status", "severity", "raw_log",
    "mfa_authenticated", "device_compliant_status", "user_agent", "geo_country",
    "account_type", "principal_type", "principal_created_in_window",
    "is_known_proxy_or_tor", "ua_family", "ua_version",
)


# ------------------------------------------------------------ source detection

def detect_source(raw: Column) -> Column:
    """Provider with most signature keys; UNKNOWN on none or on a tie."""
    clouds = F.array(*map(F.lit, SIGNATURES))

    def hits(keys: Column) -> Column:
        return F.array(
            *[
                F.size(F.array_intersect(keys, F.array(*map(F.lit, signature))))
                for signature in SIGNATURES.values()
            ]
        )

    def winner(counts: Column) -> Column:
        best = F.array_max(counts)
        alone = F.size(F.filter(counts, lambda n: n == best)) == 1
        return F.when((best > 0) & alone, F.element_at(clouds, F.array_position(counts, best).cast("int")))

    found = events.let(F.json_object_keys(raw), lambda keys: events.let(hits(keys), winner))
    return F.coalesce(found, F.lit("UNKNOWN"))


# ------------------------------------------------------------- variant access

class Record:
    """Reads one parsed record; tells missing, null and wrongly typed fields apart."""

    def __init__(self, column: Column):
        self.column = column
        self.made: dict[tuple[str, str], Column] = {}

    def get(self, path: str, kind: str) -> Column:
        """The field as a value of a kind; asked for again, the same expression."""
        if (path, kind) not in self.made:
            self.made[path, kind] = self.find(path, kind)
        return self.made[path, kind]

    def find(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.column, path, kind)

    def piece(self, path: str) -> Column:
        return self.get(path, "variant")

    def missing(self, path: str) -> Column:
        return self.piece(path).isNull()

    def schema(self, path: str) -> Column:
        return F.schema_of_variant(self.piece(path))

    def text(self, path: str) -> Column:
        """Any scalar as text."""
        return self.get(path, "string")

    @cache
    def string(self, path: str) -> Column:
        """Text only if the field holds a string."""
        return F.when(self.schema(path) == "STRING", self.text(path))

    def string_or(self, path: str, default: Column) -> Column:
        return F.when(self.missing(path), default).otherwise(self.string(path))

    def number(self, path: str) -> Column:
        return self.get(path, "double")

    def truthy(self, path: str, likely: str | None = None) -> Column:
        """Present and neither null, false, zero, nor empty.

        ``likely`` names a part that usually exists, which settles the question early.
        """
        as_text = F.to_json(self.piece(path))
        empty = as_text.isin("null", "false", "0", "0.0", '""', "[]", "{}")
        full = F.coalesce(~empty, F.lit(False))
        if likely is None:
            return F.when(self.missing(path), False).otherwise(full)
        return F.when(~self.missing(path + likely), True).otherwise(full)

    def boolean(self, path: str) -> Column:
        """The value of a real JSON boolean, NULL for anything else."""
        return F.when(self.schema(path) == "BOOLEAN", self.get(path, "boolean"))

    def not_object(self, path: str, likely: str) -> Column:
        """Present but not an object; an existing ``likely`` member settles it early."""
        return F.when(self.missing(path) | ~self.missing(f"{path}.{likely}"), False).otherwise(
            ~self.schema(path).startswith("OBJECT")
        )


# Every field that the parsers read. Leaves keep their JSON type, so that text, number and null
# stay apart; ``operationName`` and ``mfaDetail`` may be objects or not.
TYPED = {
    "eventID": None, "eventTime": None, "eventType": None, "eventName": None, "errorCode": None,
    "errorMessage": None, "sourceIPAddress": None, "userAgent": None,
    "userIdentity": {"type": None, "arn": None, "principalId": None, "userName": None},
    "resources": [{"ARN": None}],
    "additionalEventData": {"MFAUsed": None},
    "requestParameters": {"userName": None},
    "ml_labels": {"severity_score": None, "threat_category": None, "anomaly_flag": None},
    "time": None, "category": None, "operationName": None, "resultType": None,
    "properties": {
        "id": None, "userPrincipalName": None, "servicePrincipalName": None, "appId": None, "userId": None,
        "ipAddress": None, "userAgent": None, "mfaDetail": None, "deviceDetail": {"isCompliant": None},
        "targetResources": [{"displayName": None, "id": None}],
    },
    "insertId": None, "timestamp": None,
    "protoPayload": {
        "methodName": None, "resourceName": None, "status": {"code": None}, "request": {"accountId": None},
        "authenticationInfo": {"principalEmail": None, "principalSubject": None},
        "requestMetadata": {"callerIp": None, "callerSuppliedUserAgent": None},
    },
}
# Objects whose absence is fine but whose null is a wrong type; typed parsing does not tell these apart.
_NULL_IS_WRONG = (
    "userIdentity", "ml_labels", "properties", "protoPayload", "protoPayload.status",
    "protoPayload.authenticationInfo", "protoPayload.requestMetadata",
)


def _ddl(fields) -> str:
    if fields is None:
        return "variant"
    if isinstance(fields, list):
        return f"array<{_ddl(fields[0])}>"
    return "struct<" + ", ".join(f"`{name}`: {_ddl(inner)}" for name, inner in fields.items()) + ">"


class TypedRecord(Record):
    """The same questions to a record parsed with ``TYPED``: fields are looked up by position."""

    def _at(self, path: str) -> tuple[Column, str, object]:
        """(column, rest of the path, what the schema has there)."""
        column, fields = self.column, TYPED
        steps = path.removeprefix("$").replace("[", ".[").split(".")[1:]
        for i, step in enumerate(steps):
            if fields is None:
                return column, "$" + "".join(s if s[0] == "[" else f".{s}" for s in steps[i:]), None
            if step[0] == "[":
                column, fields = F.get(column, F.lit(int(step[1:-1]))), fields[0]
            else:
                column, fields = column[step], fields[step]
        return column, "$", fields

    def find(self, path: str, kind: str) -> Column:
        column, rest, fields = self._at(path)
        if kind == "variant" and (fields is not None or rest == "$"):
            return column
        if fields is not None:
            raise ValueError(f"{path} is not a leaf")
        return F.try_variant_get(column, rest, kind)

    def truthy(self, path: str, likely: str | None = None) -> Column:
        column, _, fields = self._at(path)
        if isinstance(fields, list):
            return F.coalesce(F.size(column) > 0, F.lit(False))
        return super().truthy(path, likely)

    def not_object(self, path: str, likely: str) -> Column:
        return F.lit(False)

    @staticmethod
    def unsure(typed: Column, raw: Column) -> Column:
        """Records that the schema does not fit, or where a null object may be meant."""
        odd = typed["_corrupt_record"].isNotNull()
        for path in _NULL_IS_WRONG:
            column = typed
            for step in path.split("."):
                column = column[step]
            odd = odd | (column.isNull() & raw.contains(f'"{path.split(".")[-1]}"'))
        return odd


def _literal(text: str | None, kind: str = "string") -> Column:
    return F.lit(text).cast(kind)


def parse_aws(r: Record) -> dict[str, Column]:
    kind = r.string_or("$.userIdentity.type", F.lit("Unknown"))
    account = (
        F.when(kind.isin(*AWS_USER_TYPES), "USER")
        .when(kind.isin(*AWS_SERVICE_TYPES), "SERVICE")
        .otherwise("UNKNOWN")
    )
    failed = r.truthy("$.errorCode") | r.truthy("$.errorMessage")
    score = r.number("$.ml_labels.severity_score")
    has_score = ~r.missing("$.ml_labels.severity_score") & (
        ~F.is_variant_null(r.piece("$.ml_labels.severity_score"))
    )
    return {
        "event_id": r.text("$.eventID"),
        "__time": r.text("$.eventTime"),
        "event_type": r.string_or("$.eventType", F.lit("Unknown")),
        "user_id": r.string_or(
            "$.userIdentity.arn", r.string_or("$.userIdentity.principalId", kind)
        ),
        "source_ip": r.text("$.sourceIPAddress"),
        "resource": F.when(
            r.truthy("$.resources", "[0]"), r.string_or("$.resources[0].ARN", F.lit("None"))
        ).otherwise("None"),
        "action": r.string("$.eventName"),
        "status": F.when(failed, "FAILED").otherwise("SUCCESS"),
        "severity": F.when(has_score, events.severity_from_score(score)).otherwise(
            F.when(failed, "HIGH").otherwise("LOW")
        ),
        "mfa_authenticated": F.coalesce(
            F.lower(r.text("$.additionalEventData.MFAUsed")) == "yes", F.lit(False)
        ),
        "device_compliant_status": _literal(None),
        "user_agent": r.string_or("$.userAgent", F.lit("Unknown")),
        "account_type": account,
        "principal_type": kind,
        "principal_key": events.first_text(
            r.text("$.userIdentity.arn"), r.text("$.userIdentity.userName"),
            r.text("$.userIdentity.principalId"),
        ),
        "created_principal_name": r.text("$.requestParameters.userName"),
        "__broken": r.not_object("$.userIdentity", "type") | r.not_object("$.ml_labels", "severity_score"),
    }


def parse_azure(r: Record) -> dict[str, Column]:
    result = F.coalesce(r.text("$.resultType"), F.lit(""))
    failed = (result != "0") & (F.lower(result) != "success")
    upn = F.nullif(r.text("$.properties.userPrincipalName"), F.lit(""))
    first_target = "$.properties.targetResources[0]"
    compliant = r.boolean("$.properties.deviceDetail.isCompliant")
    is_service = r.truthy("$.properties.appId") & upn.isNull()
    return {
        "event_id": r.text("$.properties.id"),
        "__time": r.text("$.time"),
        "event_type": r.string_or("$.category", F.lit("Unknown")),
        "user_id": F.coalesce(
            upn, r.string_or("$.properties.servicePrincipalName", F.lit("Unknown"))
        ),
        "source_ip": r.text("$.properties.ipAddress"),
        "resource": F.when(
            r.truthy("$.properties.targetResources", "[0]"),
            F.coalesce(
                F.nullif(r.string(f"{first_target}.displayName"), F.lit("")),
                r.string_or(f"{first_target}.id", F.lit("Unknown")),
            ),
        ).otherwise("Unknown"),
        "action": F.when(
            ~r.missing("$.operationName.value"), r.string("$.operationName.value")
        ).otherwise(r.string("$.operationName")),
        "status": F.when(failed, "FAILED").otherwise("SUCCESS"),
        "severity": events.severity_from_score(r.number("$.ml_labels.severity_score")),
        "mfa_authenticated": r.truthy("$.properties.mfaDetail", ".authMethod"),
        "device_compliant_status": F.when(compliant, "Compliant")
        .when(~compliant, "NonCompliant")
        .otherwise("Unknown"),
        "user_agent": r.string_or("$.properties.userAgent", F.lit("Unknown")),
        "account_type": F.lit("UNKNOWN"),
        "principal_type": F.when(is_service, "ServicePrincipal").otherwise("User"),
        "principal_key": events.first_text(
            upn, r.text("$.properties.appId"), r.text("$.properties.userId")
        ),
        "created_principal_name": _literal(None),
        "__broken": r.not_object("$.properties", "id") | r.not_object("$.ml_labels", "severity_score"),
    }


def parse_gcp(r: Record) -> dict[str, Column]:
    code = r.text("$.protoPayload.status.code")
    identity = "$.protoPayload.authenticationInfo"
    email = r.text(f"{identity}.principalEmail")
    score = r.number("$.ml_labels.severity_score")
    null_score = ~r.missing("$.ml_labels.severity_score") & score.isNull()
    return {
        "event_id": r.text("$.insertId"),
        "__time": r.text("$.timestamp"),
        "event_type": r.string_or("$.protoPayload.methodName", F.lit("Unknown")),
        "user_id": r.string_or(f"{identity}.principalEmail", F.lit("Unknown")),
        "source_ip": r.text("$.protoPayload.requestMetadata.callerIp"),
        "resource": r.string_or("$.protoPayload.resourceName", F.lit("Unknown")),
        "action": r.string_or("$.protoPayload.methodName", F.lit("Unknown")),
        "status": F.when(
            r.missing("$.protoPayload.status.code") | (code.try_cast("double") == 0), "SUCCESS"
        ).otherwise("FAILED"),
        "severity": events.severity_from_score(score * 5),
        "mfa_authenticated": F.lit(False),
        "device_compliant_status": _literal(None),
        "user_agent": r.string_or(
            "$.protoPayload.requestMetadata.callerSuppliedUserAgent", F.lit("Unknown")
        ),
        "account_type": F.lit("UNKNOWN"),
        "principal_type": F.when(
            F.coalesce(email.endswith(GCP_SERVICE_SUFFIX), F.lit(False)), "ServiceAccount"
        ).otherwise("User"),
        "principal_key": events.first_text(email, r.text(f"{identity}.principalSubject")),
        "created_principal_name": r.text("$.protoPayload.request.accountId"),
        "__broken": r.not_object("$.protoPayload", "methodName")
        | r.not_object("$.ml_labels", "severity_score")
        | r.not_object("$.protoPayload.status", "code")
        | r.not_object(identity, "principalEmail")
        | r.not_object("$.protoPayload.requestMetadata", "callerIp")
        | null_score,
    }


# --------------------------------------------------------------- ground truth

def actor_name(r: Record, cloud: Column) -> Column:
    """Bare actor name shared by one identity's records in every cloud."""
    arn = r.text("$.userIdentity.arn")
    aws = F.coalesce(
        F.nullif(r.text("$.userIdentity.userName"), F.lit("")),
        F.when(arn.contains("/"), F.element_at(F.split(arn, "/"), -1)),
        F.nullif(arn, F.lit("")),
        r.text("$.userIdentity.principalId"),
    )
    azure = events.first_text(
        r.text("$.properties.userPrincipalName"), r.text("$.properties.servicePrincipalName")
    )
    gcp = events.first_text(r.text("$.protoPayload.authenticationInfo.principalEmail"))

    def local_part(address: Column) -> Column:
        return F.get(F.split(address, "@"), F.lit(0))

    return (
        F.when(cloud == "AWS", aws)
        .when(cloud.isin("AZURE", "ENTRA-ID"), local_part(azure))
        .when(cloud == "GCP", local_part(gcp))
    )


# -------------------------------------------------------------- the operators

@lru_cache(maxsize=2)
def _record(_jvm: int) -> tuple[Column, list[str]]:
    """What is read of a record, and the names of the parsed fields.

    Works on ``__s`` (typed), ``__v`` (variant), ``__raw`` and ``__cloud``. Some thousand
    expressions, so a driver builds them once and not for every batch of a stream.
    """
    fields = []

    def of(r: Record, cloud: Column) -> Column:
        parsed = {"AWS": parse_aws(r), "AZURE": parse_azure(r), "GCP": parse_gcp(r)}
        fields[:] = parsed["AWS"]
        known = [(cloud == name, values) for name, values in parsed.items()]

        def by_cloud(name: str) -> Column:
            return reduce(lambda acc, item: acc.when(item[0], item[1][name]), known, F.when(F.lit(False), F.lit(None)))

        return F.struct(
            *[by_cloud(n).alias(n) for n in fields],
            r.text("$.ml_labels.threat_category").alias("threat_category"),
            r.missing("$.ml_labels.threat_category").alias("__no_category"),
            r.number("$.ml_labels.severity_score").alias("severity_score"),
            r.boolean("$.ml_labels.anomaly_flag").alias("anomaly_flag"),
            actor_name(r, cloud).alias("gt_principal"),
        )

    # Records of the usual types are read from the typed parse, all others field by field. The
    # rare branch is a lambda, which keeps it out of the generated code.
    odd = F.col("__v").isNull() | TypedRecord.unsure(F.col("__s"), F.col("__raw"))
    rare = events.let(F.struct("__v", "__cloud"), lambda x: of(Record(x["__v"]), x["__cloud"]))
    return F.when(odd, rare).otherwise(of(TypedRecord(F.col("__s")), F.col("__cloud"))), fields


def parse(df: DataFrame, raw_col: str = "raw", cloud_col: str | None = None) -> DataFrame:
    """One row per record: unified columns, labels, ground truth and ``error`` (NULL if good)."""
    cloud = F.upper(F.col(cloud_col)) if cloud_col else detect_source(F.col(raw_col))
    typed = F.from_json(raw_col, _ddl(TYPED | {"_corrupt_record": None}).replace("`_corrupt_record`: variant", "`_corrupt_record`: string"))
    base = df.select("*", cloud.alias("__cloud"), F.try_parse_json(raw_col).alias("__v"), typed.alias("__s"), F.col(raw_col).alias("__raw"))
    # Generated rows keep filters on the results from being rewritten into the parsing
    # expressions, which would then run once per reference.
    record, fields = _record(id(df.sparkSession._jvm))
    wide = base.select(*df.columns, "__v", "__cloud", F.explode(F.array(record)).alias("__r")).select(
        *df.columns, "__v", "__cloud", "__r.*"
    )
    ua = F.col("user_agent")
    wide = wide.select(
        *df.columns,
        F.col("__cloud").alias("source_cloud"),
        *[F.col(n) for n in fields if not n.startswith("__")],
        events.parse_time(F.col("__time")).alias("timestamp"),
        _literal(None).alias("destination_ip"),
        F.col("__v").alias("raw_log"),
        events.let(
            agents.ua_family(ua),
            lambda family: F.struct(
                family.alias("family"), agents.ua_version(ua, family).alias("version")
            ),
        ).alias("__ua"),
        F.when(F.col("__no_category"), "Normal").otherwise(F.col("threat_category")).alias(
            "threat_category"
        ),
        "severity_score", "anomaly_flag", "gt_principal",
        F.coalesce(F.col("__broken"), F.lit(False)).alias("__broken"),
    )
    wide = wide.select(
        "*", F.col("__ua.family").alias("ua_family"), F.col("__ua.version").alias("ua_version")
    ).drop("__ua")
    ip = F.col("source_ip")
    rules = [
        F.when(~F.col("source_cloud").isin(*SIGNATURES), F.concat(
            F.lit("No parser configured or detected for cloud: "), F.col("source_cloud"))),
        F.when(F.col("raw_log").isNull(), "record is not valid JSON"),
        F.when(F.col("__broken"), "unexpected field type"),
        F.when(F.col("timestamp").isNull(), "Invalid timestamp format"),
        F.when(ip.isNotNull() & ~net.is_ip(ip), "source_ip is not a valid IP address"),
        *[F.when(F.col(n).isNull(), f"{n} is missing or not a string") for n in REQUIRED],
    ]
    return wide.withColumn(
        "error", F.nullif(F.array_join(F.array_compact(F.array(*rules)), "; "), F.lit(""))
    ).drop("__broken")


def normalize(
    df: DataFrame, raw_col: str = "raw", cloud_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters). Dead letters are ``(error, raw_log)`` as text.

    Each of the two runs the parse; keep ``parse`` and ``split`` it where both are written.
    """
    return split(parse(df, raw_col, cloud_col), raw_col)


def split(parsed: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Good events and dead letters of parsed records."""
    good = parsed.where(F.col("error").isNull()).drop("error", raw_col)
    dead = parsed.where(F.col("error").isNotNull()).select(
        "error", F.col(raw_col).alias("raw_log")
    )
    return good, dead


def with_ground_truth(df: DataFrame) -> DataFrame:
    """0/1 attack label from the threat category; benign oddities stay benign."""
    return df.withColumn("is_attack", events.is_attack(F.col("threat_category")).cast("int"))


def counters(parsed: DataFrame) -> DataFrame:
    """Received / normalized / failed records."""
    return parsed.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("error").isNull()).alias("normalized"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def observed(parsed: DataFrame, name: str = "normalization") -> tuple[DataFrame, Observation]:
    """The same counters as a side product of whatever job reads the result."""
    watch = Observation(name)
    return (
        parsed.observe(
            watch,
            F.count(F.lit(1)).alias("received"),
            F.count_if(F.col("error").isNull()).alias("normalized"),
            F.count_if(F.col("error").isNotNull()).alias("failed"),
        ),
        watch,
    )


def bridge(df: DataFrame) -> DataFrame:
    """Give pre-normalized rows the fields the later stages use."""
    principal = F.col("user_id")
    if "principal" in df.columns:
        principal = F.coalesce(F.col("principal"), principal)
    return df.withColumns(
        {
            "principal": F.coalesce(principal, F.lit("unknown_principal")),
            "timestamp": F.col("timestamp").cast("timestamp"),
            "source_ip": F.col("source_ip").cast("string"),
        }
    )
