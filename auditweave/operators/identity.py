"""Cross-cloud identity stitching as joins, aggregates and one ordered replay.

Order of resolution: federation key, known principal, creation provenance, fuzzy
match against founding events, new entity.

An event is first reduced to a *node*: its federation key, else the key its
principal last used, else the principal itself. Only the first event of a node can
take a decision, so everything after that works on the node table (one row per
identity) and on activity sessions (one row per node and burst), not on events.

Fuzzy decisions depend on earlier ones, but only inside a block: without an equal,
known user-agent family no pair reaches the threshold, and inside a family only
profiles that can reach it together share a block. A block is replayed in time order
by a streaming pass that keeps counts of active entities per profile instead of
comparing pairs; large blocks are cut into time segments that are replayed side by side
(``segments``).

A federation key and a principal with the same text are the same identity. An
identity that is itself re-pointed keeps its earlier events where they were.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditweave.functions import agents, events
from auditweave.operators import ordered, replay, segments
from auditweave.session import cut_lineage, ship_by_value

ship_by_value(replay)

# Families that say nothing, and tools that count as automation.
UNINFORMATIVE_FAMILIES = ("Unknown", "Other", "")
UNINFORMATIVE_VERSIONS = ("Unknown", "Other", "")
AUTOMATION_FAMILIES = (
    "Boto3", "aws-cli", "aws-sdk-go", "Terraform", "azure-cli", "google-cloud-sdk", "pulumi",
)
# Method to audit tier.
AUDIT_TIERS = {
    "federation": "1-federation",
    "provenance": "1.5-provenance",
    "fast_path": "fast_path",
    "fuzzy_merge": "2-fuzzy",
    "new_entity": "new",
    "new_entity_ambiguous": "new",
}

ATTRIBUTES = ("ua_family", "ua_version", "proxy", "kind", "source_ip")


@dataclass(frozen=True)
class StitchParams:
    similarity_threshold: float = 0.65
    ambiguity_margin: float = 0.05
    lookback_seconds: float = 10_800.0
    window_seconds: float = 60.0
    ua_weight: float = 0.45
    proxy_weight: float = 0.25
    type_weight: float = 0.20
    ip_weight: float = 0.10

    def __post_init__(self):
        if self.ambiguity_margin <= 0:
            raise ValueError("ambiguity_margin must be positive")
        without_family = self.ua_weight * 0.20 + self.type_weight + max(
            self.proxy_weight, self.ip_weight
        )
        if round(without_family, 4) >= self.similarity_threshold:
            raise ValueError(
                "these weights let a pair match without a common user-agent family; "
                "blocking by family would lose it"
            )

    @property
    def lookback_us(self) -> int:
        return int(round(self.lookback_seconds * events.MICROS))


# ------------------------------------------------------------------ similarity

def similarity_parts(a: dict[str, Column], b: dict[str, Column], p: StitchParams = StitchParams()):
    """The four signals of a pair; sides map ATTRIBUTES to columns."""
    fam_a = F.coalesce(a["ua_family"], F.lit("Unknown"))
    fam_b = F.coalesce(b["ua_family"], F.lit("Unknown"))
    same_family = (fam_a == fam_b) & ~fam_a.isin(*UNINFORMATIVE_FAMILIES)
    same_version = F.coalesce(
        (a["ua_version"] == b["ua_version"]) & ~a["ua_version"].isin(*UNINFORMATIVE_VERSIONS),
        F.lit(False),
    )
    zero = F.lit(0.0)
    agent = (
        F.when(
            same_family,
            F.lit(p.ua_weight * 0.70) + F.when(same_version, p.ua_weight * 0.30).otherwise(zero),
        )
        .when(
            fam_a.isin(*AUTOMATION_FAMILIES) & fam_b.isin(*AUTOMATION_FAMILIES),
            p.ua_weight * 0.20,
        )
        .otherwise(zero)
    )
    proxy_a = F.coalesce(a["proxy"], F.lit(False))
    proxy_b = F.coalesce(b["proxy"], F.lit(False))
    proxy = F.when(proxy_a & proxy_b, p.proxy_weight).otherwise(zero)
    same_ip = F.coalesce(
        (a["source_ip"] == b["source_ip"]) & (a["source_ip"] != ""), F.lit(False)
    )
    ip = F.when(~proxy_a & ~proxy_b & same_ip, p.ip_weight).otherwise(zero)
    kind = F.when(
        F.coalesce(a["kind"] == b["kind"], F.lit(False)), p.type_weight
    ).otherwise(zero)
    return {"ua": agent, "proxy": proxy, "ip": ip, "type": kind}


def similarity(a: dict[str, Column], b: dict[str, Column], p: StitchParams = StitchParams()):
    s = similarity_parts(a, b, p)
    return F.round(s["ua"] + s["proxy"] + s["ip"] + s["type"], 4)


def similarity_breakdown(
    a: dict[str, Column], b: dict[str, Column], p: StitchParams = StitchParams()
) -> Column:
    s = {name: F.round(part, 4) for name, part in similarity_parts(a, b, p).items()}
    total = F.round(s["ua"] + s["proxy"] + s["ip"] + s["type"], 4)
    return F.struct(*[part.alias(name) for name, part in s.items()], total.alias("total"))


def side(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(f"{prefix}{name}") for name in ATTRIBUTES}


def attributes(df: DataFrame) -> dict[str, Column]:
    """Stitching attributes of an event row, defaults included."""

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    proxy = F.lit(False)
    if "is_known_proxy_or_tor" in df.columns:
        proxy = F.coalesce(F.col("is_known_proxy_or_tor").cast("boolean"), F.lit(False))
    return {
        "ua_family": F.coalesce(text("ua_family"), F.lit("Unknown")),
        "ua_version": text("ua_version"),
        "proxy": proxy,
        "kind": agents.stitch_class(text("principal_type")),
        "source_ip": text("source_ip"),
    }


# ---------------------------------------------------------------------- state

@dataclass
class StitchState:
    """What a later batch has to know about earlier ones (all plain tables).

    identity   key, entity_id
    provenance created, entity_id
    anchors    entity_id, ua_family, ua_version, proxy, kind, source_ip, founded_us
    activity   entity_id, start_us, end_us
    clouds     entity_id, clouds
    """

    identity: DataFrame
    provenance: DataFrame
    anchors: DataFrame
    activity: DataFrame
    clouds: DataFrame


@dataclass
class Resolution:
    """Stitched events plus the node table they came from."""

    events: DataFrame
    nodes: DataFrame
    columns: list[str] = field(default_factory=list)


def _clean_key(column: Column) -> Column:
    text = F.trim(column.cast("string"))
    return F.when(text.isin("", "None", "null"), None).otherwise(text)


def _entity_id(node: Column, at: Column, event: Column) -> Column:
    return F.concat(F.lit("entity_"), F.sha2(F.concat_ws("|", node, at, event), 256).substr(1, 32))


def _assign_nodes(df: DataFrame, ts: str, order: str, skew: dict) -> DataFrame:
    base = df.withColumns(
        {
            "__t": events.micros(F.col(ts)),
            "__id": F.col(order),
            "__fed": _clean_key(F.col("federation_id"))
            if "federation_id" in df.columns
            else F.lit(None).cast("string"),
        }
    )
    if "federation_id" not in df.columns:
        return base.withColumn("__node", F.col("principal"))
    sliced = ordered.with_slices(base, ["principal"], "__t", **skew)
    pointed = ordered.running(
        sliced, "__t", [order], {"__current": ordered.latest(F.col("__fed"))}
    ).plain()
    return pointed.withColumn("__node", F.coalesce("__current", "principal")).drop("__current")


def _creators(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent): the latest creation of a principal before its own first event."""
    if "created_principal_name" not in base.columns:
        return None
    made = base.where(F.nullif(F.col("created_principal_name"), F.lit("")).isNotNull()).select(
        F.col("created_principal_name").alias("__made"),
        F.struct("__t", "__id").alias("__when"),
        F.col("__node").alias("__parent"),
    )
    fresh = nodes.where(~F.col("federated") & F.col("known_entity").isNull()).select(
        "node", F.struct(F.col("first_us").alias("__t"), F.col("first_id").alias("__id")).alias("__first")
    )
    return (
        fresh.join(made, F.col("node") == F.col("__made"))
        .where(F.col("__when") < F.col("__first"))
        .groupBy("node")
        .agg(F.max_by("__parent", "__when").alias("parent"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """Follow parents to the top by doubling: chains of length n take log2(n) rounds."""
    current = cut_lineage(links.select("node", F.col("parent").alias("root")))
    while True:
        up = current.select(F.col("node").alias("__n"), F.col("root").alias("__up"))
        stepped = cut_lineage(
            current.join(up, F.col("root") == F.col("__n"), "left").select(
                "node",
                F.coalesce("__up", "root").alias("root"),
                F.col("__up").isNotNull().alias("moved"),
            )
        )
        if stepped.where("moved").isEmpty():
            return stepped.select("node", "root")
        current = stepped.select("node", "root")


def resolve_entities(
    df: DataFrame,
    state: StitchState | None = None,
    params: StitchParams = StitchParams(),
    *,
    ts: str = "timestamp",
    order: str = "event_id",
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
    segment_rows: int = segments.SEGMENT_ROWS,
) -> Resolution:
    """Add ``entity_id``, ``method``, ``is_new`` and ``similarity`` to every event."""
    skew = {"hot_rows": hot_rows, "slice_us": slice_us}
    base = _assign_nodes(df, ts, order, skew)
    attrs = attributes(base)
    base = base.withColumns({f"__{n}": c for n, c in attrs.items()})

    first = F.min(
        F.struct(
            F.col("__t"), F.col("__id"), F.col("__fed").isNotNull().alias("federated"),
            *[F.col(f"__{n}").alias(n) for n in ATTRIBUTES],
        )
    )
    nodes = base.groupBy(F.col("__node").alias("node")).agg(first.alias("f")).select(
        "node",
        F.col("f.__t").alias("first_us"),
        F.col("f.__id").alias("first_id"),
        F.col("f.federated").alias("federated"),
        *[F.col(f"f.{n}").alias(n) for n in ATTRIBUTES],
    )
    if state is not None:
        nodes = nodes.join(
            state.identity.select(
                F.col("key").alias("__key"), F.col("entity_id").alias("known_entity")
            ),
            F.col("node") == F.col("__key"), "left",
        ).drop("__key")
    else:
        nodes = nodes.withColumn("known_entity", F.lit(None).cast("string"))
    nodes = cut_lineage(nodes)

    links = _creators(base, nodes)
    if links is not None:
        links = cut_lineage(links)
        if links.isEmpty():
            links = None
    if links is not None:
        nodes = nodes.join(_roots(links).withColumnRenamed("node", "__n"),
                           F.col("node") == F.col("__n"), "left").drop("__n")
    else:
        nodes = nodes.withColumn("root", F.lit(None).cast("string"))
    nodes = nodes.withColumn("by_creation", F.col("root").isNotNull())
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    if state is not None:
        remembered = state.provenance.select(
            F.col("created").alias("__made"), F.col("entity_id").alias("__maker")
        )
        nodes = nodes.join(remembered, F.col("node") == F.col("__made"), "left")
        inherits = (
            F.col("known_entity").isNull() & ~F.col("federated") & ~F.col("by_creation")
            & F.col("__maker").isNotNull()
        )
        nodes = nodes.select(
            *[c for c in nodes.columns if c not in ("known_entity", "__made", "__maker")],
            F.when(inherits, F.col("__maker")).otherwise(F.col("known_entity")).alias("known_entity"),
            inherits.alias("by_memory"),
        )
    else:
        nodes = nodes.withColumn("by_memory", F.lit(False))
    nodes = nodes.withColumn(
        "founded_id", _entity_id(F.col("node"), F.col("first_us"), F.col("first_id"))
    )
    if links is not None or state is not None:
        nodes = cut_lineage(nodes)

    decisions = _fuzzy(base, nodes, state, params, segment_rows)

    tops = nodes.select(
        F.col("node").alias("__top"),
        F.coalesce("known_entity", "founded_id").alias("__own_entity"),
        F.col("federated").alias("__top_federated"),
    ).join(decisions, F.col("__top") == F.col("decided"), "left")
    labelled = nodes.join(tops, F.col("root") == F.col("__top"), "left")
    # A decision names the entity by node ("n:") or, for a remembered one, by id ("k:").
    founders = nodes.select(
        F.col("node").alias("__founder"), F.col("founded_id").alias("__founder_id")
    )
    labelled = labelled.withColumn(
        "__target", F.when(F.col("owner").startswith("n:"), F.expr("substr(owner, 3)"))
    ).join(founders, F.col("__target") == F.col("__founder"), "left")
    entity = (
        F.when(F.col("owner").startswith("k:"), F.expr("substr(owner, 3)"))
        .when(F.col("__target").isNotNull(), F.col("__founder_id"))
        .otherwise(F.col("__own_entity"))
    )
    method = (
        F.when(F.col("federated"), "federation")
        .when(F.col("by_creation") | F.col("by_memory"), "provenance")
        .when(F.col("known_entity").isNotNull(), "fast_path")
        .otherwise(F.coalesce("decision", F.lit("new_entity")))
    )
    node_map = labelled.select(
        "node", entity.alias("entity_id"), method.alias("node_method"),
        F.when(~F.col("by_creation") & ~F.col("by_memory"), F.col("similarity")).alias("node_similarity"),
        (
            (method.isin("new_entity", "new_entity_ambiguous")
             | (F.col("federated") & F.col("known_entity").isNull()))
        ).alias("founds"),
        "first_us", "first_id", "known_entity", *ATTRIBUTES,
    )
    node_map = cut_lineage(node_map)

    joined = base.join(
        node_map.select(
            F.col("node").alias("__n"), "entity_id", "node_method", "node_similarity", "founds",
            "first_us", "first_id",
        ),
        F.col("__node") == F.col("__n"),
    )
    is_first = (F.col("__t") == F.col("first_us")) & (F.col("__id") == F.col("first_id"))
    out = joined.select(
        *df.columns,
        "entity_id",
        F.when(F.col("__fed").isNotNull(), "federation")
        .when(is_first, F.col("node_method"))
        .otherwise("fast_path")
        .alias("method"),
        (is_first & F.col("founds")).alias("is_new"),
        F.when(is_first & F.col("__fed").isNull(), F.col("node_similarity")).alias("similarity"),
    )
    return Resolution(out, node_map, list(df.columns))


def sessions(base: DataFrame, keys: list[str], at: str, identifier: str, lookback_us: int) -> DataFrame:
    """Bursts of activity with no pause longer than the lookback, as (start, end).

    Rows are first reduced per hour, so a hot key reaches the window as at most one row
    per hour of history.
    """
    bucket = min(lookback_us, 3600 * events.MICROS)
    hourly = base.groupBy(*keys, F.floor(F.col(at) / bucket).alias("__h")).agg(
        F.min(F.struct(F.col(at).alias("t"), F.col(identifier).alias("id"))).alias("__from"),
        F.max(at).alias("__to"),
    )
    ordered_hours = Window.partitionBy(*keys).orderBy("__h")
    gap = F.col("__from.t") - F.lag("__to").over(ordered_hours)
    numbered = hourly.withColumn(
        "__break", F.coalesce(gap > lookback_us, F.lit(False)).cast("long")
    ).withColumn("__no", F.sum("__break").over(ordered_hours))
    return (
        numbered.groupBy(*keys, "__no")
        .agg(F.min("__from").alias("__from"), F.max("__to").alias("end_us"))
        .select(
            *keys, F.col("__from.t").alias("start_us"), F.col("__from.id").alias("start_id"), "end_us"
        )
    )


def _in_play() -> Column:
    family = F.col("ua_family")
    version_known = F.coalesce(~F.col("ua_version").isin(*UNINFORMATIVE_VERSIONS), F.lit(False))
    return (
        F.coalesce(~family.isin(*UNINFORMATIVE_FAMILIES), F.lit(False))
        & (F.col("proxy") | (version_known & F.col("kind").isNotNull()))
    )


def _uses_default_weights(params: StitchParams) -> bool:
    d = StitchParams()
    names = ("similarity_threshold", "ua_weight", "proxy_weight", "type_weight", "ip_weight")
    return all(getattr(params, n) == getattr(d, n) for n in names)


def _fuzzy(base, nodes, state, params, segment_rows) -> DataFrame:
    """(decided, decision, owner, similarity) for every root principal that may match."""
    fine = _uses_default_weights(params)
    family_known = F.coalesce(
        ~F.col("ua_family").isin(*UNINFORMATIVE_FAMILIES), F.lit(False)
    )
    roots = nodes.where(
        (F.col("root") == F.col("node")) & F.col("known_entity").isNull()
    ).select(
        F.concat(F.lit("n:"), F.col("node")).alias("label"),
        F.col("first_us").alias("at"), F.col("first_id").cast("string").alias("id"),
        F.col("first_id").alias("oid"),
        F.col("federated").alias("must_found"), *ATTRIBUTES,
    )
    actors = roots
    if state is not None:
        remembered = state.anchors.select(
            F.concat(F.lit("k:"), F.col("entity_id")).alias("label"),
            F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("id"),
            F.lit(None).alias("oid"),
            F.lit(True).alias("must_found"), *ATTRIBUTES,
        )
        actors = roots.unionByName(remembered)
    actors = actors.where(_in_play() if fine else family_known)
    # Versions touched by a proxy share a block with the rest of their family's proxies;
    # everywhere else only equal family, version and type can reach the threshold.
    if fine:
        linked = actors.groupBy("ua_family", "ua_version").agg(F.max("proxy").alias("__linked"))
        actors = actors.join(
            linked.withColumnsRenamed({"ua_family": "__f", "ua_version": "__v"}),
            (F.col("ua_family") == F.col("__f")) & F.col("ua_version").eqNullSafe(F.col("__v")),
            "left",
        ).drop("__f", "__v")
        block = F.when(F.col("__linked"), F.col("ua_family")).otherwise(
            F.concat_ws("\u0001", "ua_family", "ua_version", "kind")
        )
    else:
        block = F.col("ua_family")
    actors = actors.withColumn("block", block)

    owner_label = F.when(
        F.col("known_entity").isNotNull(), F.concat(F.lit("k:"), F.col("known_entity"))
    ).otherwise(F.concat(F.lit("n:"), F.col("node")))
    root_label = nodes.select(F.col("node").alias("__r"), owner_label.alias("label"))
    labels = nodes.select("node", "root").join(root_label, F.col("root") == F.col("__r")).select(
        F.col("node").alias("__lnode"), "label"
    )
    hourly = base.groupBy(
        F.col("__node"), F.floor(F.col("__t") / min(params.lookback_us, 3600 * events.MICROS)).alias("__h")
    ).agg(
        F.min(F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"))).alias("__from"),
        F.max("__t").alias("__to"),
    )
    # Per entity and hour, so that the window below stays short for any number of nodes.
    activity = (
        hourly.join(labels, F.col("__node") == F.col("__lnode"))
        .groupBy("label", "__h")
        .agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"))
        .select(
            "label", F.col("__from.t").alias("a"), F.col("__from.id").alias("i"),
            F.col("__to").alias("b"),
        )
    )
    if state is not None:
        activity = activity.unionByName(
            state.activity.select(
                F.concat(F.lit("k:"), F.col("entity_id")).alias("label"),
                F.col("start_us").alias("a"), F.lit(None).alias("i"), F.col("end_us").alias("b"),
            )
        )
    in_order = Window.partitionBy("label").orderBy("a", F.col("i").asc_nulls_first())
    reach = F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    bursts = (
        activity.withColumn(
            "__break", F.coalesce(F.col("a") - reach > params.lookback_us, F.lit(False)).cast("long")
        )
        .withColumn("__no", F.sum("__break").over(in_order))
        .groupBy("label", "__no")
        .agg(F.min(F.struct("a", "i")).alias("s"), F.max("b").alias("until"))
    )
    final = F.max("__no").over(Window.partitionBy("label"))
    bursts = bursts.select(
        "label", F.col("s.a").alias("at"), F.col("s.i").alias("oid"),
        F.col("s.i").cast("string").alias("id"), "until",
        (F.col("__no") == final).alias("last_burst"),
    )
    no_text, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    founding = actors.select(
        "block", "label", "at", "oid", F.lit(0).alias("step"), "must_found", *ATTRIBUTES,
        F.lit(None).cast("long").alias("until"), no_flag.alias("last_burst"),
    )
    active = bursts.join(actors.select("label", "block"), "label").select(
        "block", "label", "at", "oid", F.lit(1).alias("step"), no_flag.alias("must_found"),
        no_text.alias("ua_family"), no_text.alias("ua_version"), no_flag.alias("proxy"),
        no_text.alias("kind"), no_text.alias("source_ip"), "until", "last_burst",
    )
    settings = SimpleNamespace(**asdict(params), lookback_us=params.lookback_us)
    decided = segments.decide(founding.unionByName(active), settings, segment_rows)
    return decided.select(
        F.expr("substr(label, 3)").alias("decided"), F.col("method").alias("decision"),
        "owner", "similarity",
    )


# ---------------------------------------------------------------- maintenance

def next_state(
    resolution: Resolution,
    state: StitchState | None = None,
    *,
    ts: str = "timestamp",
    in_time_order: bool = False,
) -> StitchState:
    """Tables for the next batch.

    ``in_time_order`` promises that later batches hold later events, so that only the
    newest burst of each entity has to be remembered.
    """
    ev = resolution.events.withColumn("__t", events.micros(F.col(ts)))
    fed = "federation_id" in ev.columns
    keys = ev.select(
        F.col("principal").alias("key"), "entity_id", F.struct("__t", "event_id").alias("__s")
    )
    if fed:
        keys = keys.unionByName(
            ev.where(_clean_key(F.col("federation_id")).isNotNull()).select(
                _clean_key(F.col("federation_id")).alias("key"), "entity_id",
                F.struct("__t", "event_id").alias("__s"),
            )
        )
    identity = keys.groupBy("key").agg(F.max_by("entity_id", "__s").alias("entity_id"))
    if "created_principal_name" in ev.columns:
        provenance = (
            ev.where(F.nullif(F.col("created_principal_name"), F.lit("")).isNotNull())
            .groupBy(F.col("created_principal_name").alias("created"))
            .agg(F.max_by("entity_id", F.struct("__t", "event_id")).alias("entity_id"))
        )
    else:
        provenance = identity.where(F.lit(False)).select(F.col("key").alias("created"), "entity_id")
    anchors = resolution.nodes.where("founds").select(
        "entity_id", *ATTRIBUTES, F.col("first_us").alias("founded_us")
    )
    activity = sessions(ev, ["entity_id"], "__t", "event_id", StitchParams().lookback_us).select(
        "entity_id", "start_us", "end_us"
    )
    from auditweave.operators.risk import footprints, merge_footprints

    clouds = footprints(ev)
    if state is not None:
        identity = _newer(state.identity, identity, "key")
        provenance = _newer(state.provenance, provenance, "created")
        anchors = state.anchors.unionByName(anchors)
        activity = state.activity.unionByName(activity)
        clouds = merge_footprints(state.clouds, clouds)
    if in_time_order:
        activity = activity.groupBy("entity_id").agg(
            F.max(F.struct("end_us", "start_us")).alias("s")
        ).select("entity_id", "s.start_us", "s.end_us")
    return StitchState(identity, provenance, anchors, activity, clouds)


def _newer(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def idle_entities(activity: DataFrame, now_us: int, max_idle_seconds: float) -> DataFrame:
    """(entity_id) of those whose last session ended longer ago."""
    limit = now_us - int(max_idle_seconds * events.MICROS)
    last = activity.groupBy("entity_id").agg(F.max("end_us").alias("last_seen_us"))
    return last.where(F.col("last_seen_us") < limit).select("entity_id")


def purge(state: StitchState, now_us: int, max_idle_seconds: float) -> tuple[StitchState, DataFrame]:
    """Forget entities idle for longer; returns the kept state and the purged ids."""
    stale = idle_entities(state.activity, now_us, max_idle_seconds)

    def keep(table: DataFrame) -> DataFrame:
        return table.join(stale, "entity_id", "left_anti")

    kept = StitchState(
        *[keep(t) for t in (state.identity, state.provenance, state.anchors, state.activity, state.clouds)]
    )
    return kept, stale


def entity_stats(
    events_df: DataFrame, *, ts: str = "timestamp", window_seconds: float = 60.0
) -> DataFrame:
    """One row per entity: events, principals, clouds, last seen, size of its window.

    The window is the one at the last event of the whole table.
    """
    timed = events_df.withColumn("__t", events.micros(F.col(ts)))
    now = timed.agg(F.max("__t")).scalar()
    window_us = int(window_seconds * events.MICROS)
    return (
        timed.groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("principal").alias("n_principals"),
            F.count_distinct(events.normalize_cloud(F.col("source_cloud"))).alias("n_clouds"),
            F.max("__t").alias("last_seen_us"),
            F.count_if(F.col("__t") >= now - window_us).alias("window_size"),
        )
    )


def state_summary(state: StitchState, now_us: int, window_seconds: float = 60.0) -> DataFrame:
    """One row: known entities, entities active in the window, tracked keys."""
    window_us = int(window_seconds * events.MICROS)
    entities = state.anchors.agg(F.count(F.lit(1)))
    keys = state.identity.agg(F.count(F.lit(1)))
    made = state.provenance.agg(F.count(F.lit(1)))
    active = state.activity.where(F.lit(now_us) - F.col("end_us") <= window_us).agg(
        F.count_distinct("entity_id")
    )
    return state.identity.sparkSession.range(1).select(
        entities.scalar().alias("known_entities"),
        active.scalar().alias("entities_with_active_window"),
        keys.scalar().alias("tracked_identity_keys"),
        made.scalar().alias("tracked_provenance_records"),
    )


def entity_members(events_df: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """(entity_id, key, joined_us, joined_id): when each identity key joined an entity."""
    timed = events_df.withColumn("__t", events.micros(F.col(ts)))
    keys = [F.col("principal")]
    if "federation_id" in events_df.columns:
        keys.append(_clean_key(F.col("federation_id")))
    return (
        timed.select("entity_id", F.explode(F.array(*keys)).alias("key"), "__t", "event_id")
        .where(F.col("key").isNotNull())
        .groupBy("entity_id", "key")
        .agg(F.min(F.struct("__t", "event_id")).alias("j"))
        .select(
            "entity_id", "key",
            F.col("j.__t").alias("joined_us"), F.col("j.event_id").alias("joined_id"),
        )
    )


def merge_audit(
    events_df: DataFrame,
    *,
    ts: str = "timestamp",
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """One record per assignment: tier, method, score and how many other keys it met.

    The keys themselves are the rows of ``entity_members`` that joined earlier; listing
    them inside every record would grow with the square of an entity.
    """
    timed = events_df.withColumn("__t", events.micros(F.col(ts)))
    joins = entity_members(events_df, ts=ts)
    joined = joins.groupBy(
        "entity_id", F.col("joined_us").alias("__t"), F.col("joined_id").alias("event_id")
    ).agg(F.count(F.lit(1)).alias("__new"))
    marked = timed.join(joined, ["entity_id", "__t", "event_id"], "left")
    sliced = ordered.with_slices(marked, ["entity_id"], "__t", hot_rows, slice_us)
    counted = ordered.running(
        sliced, "__t", ["event_id"],
        {"__keys": ordered.total(F.coalesce(F.col("__new"), F.lit(0)))},
    )
    return counted.df.select(
        "event_id",
        events.lookup(F.col("method"), AUDIT_TIERS).alias("tier"),
        "method",
        F.col("similarity").alias("similarity_score"),
        "entity_id",
        F.col("principal").alias("event_principal"),
        (F.col("__keys") - 1).alias("n_keys_so_far"),
    )
