"""Time-decayed cross-cloud risk per entity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.functions import agents, events
from auditweave.operators import ordered, window_mode
from auditweave.operators.ordered import Recent, recent_max, recent_min, recent_set, recent_sum
from auditweave.session import cut_lineage

LN2 = 0.6931471805599453


@dataclass(frozen=True)
class RiskParams:
    baseline: float = 0.05
    half_life_seconds: float = 1800.0
    per_cloud_multiplier: float = 3.0
    automation_cloud_multiplier: float = 1.7
    alert_threshold: float = 0.75
    window_seconds: float = 60.0

    def __post_init__(self):
        if self.baseline < 0:
            raise ValueError("baseline must not be negative")
        if self.half_life_seconds <= 0:
            raise ValueError("half_life_seconds must be positive")
        if self.per_cloud_multiplier < 1:
            raise ValueError("per_cloud_multiplier must be at least 1")
        if not 1 <= self.automation_cloud_multiplier <= self.per_cloud_multiplier:
            raise ValueError("automation_cloud_multiplier must lie in [1, per_cloud_multiplier]")
        if self.window_seconds <= 0:
            raise ValueError("window_seconds must be positive")
        if self.window_seconds / self.half_life_seconds > 400:
            raise ValueError("a window of more than 400 half-lives overflows a double")

    @property
    def window_us(self) -> int:
        return int(round(self.window_seconds * events.MICROS))


def clean_anomaly(df: DataFrame, signal: str = "anomaly_score") -> Column:
    """The signal, else phase_confidence, else 0.1; clamped to [0, 1]."""
    options = [F.col(c) for c in (signal, "phase_confidence") if c in df.columns]
    raw = F.coalesce(*options, F.lit(0.1)) if options else F.lit(0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), events.finite(raw, 0.1)))


def decay(age_seconds: Column, half_life: float) -> Column:
    return F.exp(-age_seconds * F.lit(LN2 / half_life))


def _known_cloud(column: str = "source_cloud") -> Column:
    cloud = events.normalize_cloud(F.col(column))
    return F.when(cloud != "UNKNOWN", cloud)


def lifetime_clouds(
    df: DataFrame,
    entity: str = "entity_id",
    ts: str = "timestamp",
    order: str = "event_id",
    prior: DataFrame | None = None,
    *,
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """Add ``lifetime_clouds``: every cloud the entity touched up to each event.

    ``prior`` (entity, clouds) holds footprints from before the table, such as a warm-up.
    """
    return _lifetime(df, entity, ts, order, prior, hot_rows, slice_us)[0]


def _lifetime(df, entity, ts, order, prior, hot_rows, slice_us) -> tuple[DataFrame, bool]:
    """``lifetime_clouds``, and whether some entity has more than ``hot_rows`` events."""
    kept = [c for c in df.columns if c != "lifetime_clouds"]
    base = df.select(*kept, events.micros(F.col(ts)).alias("__t"), _known_cloud().alias("__cloud"))
    sliced = ordered.with_slices(base, [entity], "__t", hot_rows, slice_us)
    out = ordered.running(
        sliced, "__t", [order], {"__seen": ordered.members(F.col("__cloud"))}
    ).plain()
    seen = F.col("__seen")
    if prior is not None:
        earlier = prior.select(
            F.col(entity).alias("__entity"), F.col("clouds").alias("__prior")
        )
        out = out.join(earlier, F.col(entity) == F.col("__entity"), "left")
        seen = F.array_union(seen, F.coalesce(F.col("__prior"), F.array().cast("array<string>")))
    return out.select(*kept, F.array_sort(seen).alias("lifetime_clouds")), sliced.any_hot


def footprints(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, clouds): the lifetime footprint, also used as the benign baseline."""
    return (
        df.select(entity, _known_cloud().alias("__cloud"))
        .groupBy(entity)
        .agg(F.array_sort(F.collect_set("__cloud")).alias("clouds"))
    )


def active_window(
    df: DataFrame,
    entity: str = "entity_id",
    ts: str = "timestamp",
    order: str = "event_id",
    window_seconds: float = 60.0,
    hot_rows: int | None = ordered.HOT_ROWS,
) -> DataFrame:
    """Add the size and the oldest time of the closed trailing window of each event.

    Windows with more than ``hot_rows`` events are spread over several tasks.
    """
    kept = df.columns
    base = df.withColumn("__t", events.micros(F.col(ts)))
    out = ordered.recent(
        base, [entity], "__t", [order], int(round(window_seconds * events.MICROS)),
        lambda _: {
            "active_events": recent_sum(F.lit(1)),
            "__oldest": recent_min(F.col("__t")),
        },
        crowded_rows=hot_rows,
    )
    return out.select(
        *kept,
        F.col("active_events").cast("long").alias("active_events"),
        F.timestamp_micros("__oldest").alias("window_start"),
    )


def score(
    df: DataFrame,
    baselines: DataFrame | None = None,
    params: RiskParams = RiskParams(),
    *,
    entity: str = "entity_id",
    ts: str = "timestamp",
    order: str = "event_id",
    prior: DataFrame | None = None,
    class_from: str = "event",
    signals: Sequence[str] = (),
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """Risk of the entity at each of its events.

    With ``signals`` (columns that stand in for ``anomaly_score``) there is one decayed sum and one
    ``scaled_score_<signal>`` for each of them, all from the same pass over the windows.

    ``baselines`` (entity, clouds) lists the clouds that are normal per entity.
    ``class_from="event"`` classifies by the event's own principal type,
    ``"window"`` by the most frequent type among the active events (ties: earliest by time
    and ``order``), whatever the number of types.
    """
    skew = {"hot_rows": hot_rows, "slice_us": slice_us}
    anomalies = {f"_{s}": clean_anomaly(df, s) for s in signals} or {"": clean_anomaly(df)}
    traced, any_hot = _lifetime(df, entity, ts, order, prior, **skew)
    kept = [c for c in df.columns if c != "lifetime_clouds"]
    ptype = F.col("principal_type") if "principal_type" in df.columns else F.lit(None).cast("string")
    kind = F.nullif(F.upper(ptype), F.lit(""))
    agent = [F.nullif(F.col(c), F.lit("")) for c in ("ua_family", "user_agent") if c in df.columns]
    base = traced.select(
        "*",
        events.micros(F.col(ts)).alias("__t"),
        _known_cloud().alias("__cloud"),
        *[a.alias(f"__a{name}") for name, a in anomalies.items()],
        agents.automation_hint(F.coalesce(*agent) if agent else F.lit("")).alias("__hint"),
        kind.alias("__type"),
    )
    rate = LN2 / params.half_life_seconds / events.MICROS

    def folds(origin: Column) -> dict[str, Recent]:
        return {
            **{
                f"__sum{name}": recent_sum(
                    F.col(f"__a{name}") * F.exp((F.col("__t") - origin) * F.lit(rate)), others_only=True
                )
                for name in anomalies
            },
            "__n": recent_sum(F.lit(1)),
            "__clouds": recent_set(F.col("__cloud")),
            "__hinted": recent_max(F.col("__hint").cast("int")),
        }

    # A window can only be crowded where an entity is hot, which was counted above.
    out = ordered.recent(
        base, [entity], "__t", [order], params.window_us, folds, crowded_rows=hot_rows if any_hot else None
    )
    origin = F.col("__window_slice") * (params.window_us + 1)
    # The event itself has weight 1 exactly; the others are scaled from the slice start.
    faded = F.exp(-(F.col("__t") - origin) * F.lit(rate))
    decayed = {name: F.col(f"__a{name}") + F.col(f"__sum{name}") * faded for name in anomalies}

    if class_from == "window":
        modes = window_mode.running_mode(
            base.select(entity, "__t", order, "__type"), entity, "__t", order, F.col("__type"), params.window_us, "__mode"
        ).dropDuplicates([entity, "__t", order])
        right = modes.withColumnsRenamed({entity: "__m_entity", "__t": "__m_t", order: "__m_order"})
        same = F.col(entity).eqNullSafe(F.col("__m_entity")) & (F.col("__t") == F.col("__m_t"))
        out = out.join(right, same & F.col(order).eqNullSafe(F.col("__m_order")), "left")
        deciding = F.col("__mode")
    else:
        deciding = F.upper(ptype)
    automated = F.coalesce(deciding.isin(*agents.RISK_AUTOMATION_TYPES), F.lit(False))
    automated = automated | (F.col("__hinted") == 1)

    if baselines is not None:
        normal = baselines.select(
            F.col(entity).alias("__entity"),
            F.filter("clouds", lambda c: c != "UNKNOWN").alias("__normal"),
        )
        out = out.join(normal, F.col(entity) == F.col("__entity"), "left").drop("__entity")
    else:
        out = out.withColumn("__normal", F.lit(None).cast("array<string>"))
    n_normal = F.coalesce(F.size("__normal"), F.lit(0))
    n_normal = F.when(F.col("__normal").isNull(), 0).otherwise(n_normal)
    touched = F.when(F.size("lifetime_clouds") == 0, F.array(F.lit("UNKNOWN"))).otherwise(
        F.col("lifetime_clouds")
    )
    novel = F.when(n_normal > 0, F.size(F.array_except(touched, F.col("__normal")))).otherwise(
        F.greatest(F.size(touched) - 1, F.lit(0))
    )
    out = out.select(
        *kept,
        F.col("lifetime_clouds").alias("active_clouds"),
        F.col("__n").cast("long").alias("window_events"),
        F.size("lifetime_clouds").alias("cloud_span_count"),
        F.size("__clouds").alias("window_cloud_span_count"),
        novel.alias("novel_cloud_span_count"),
        n_normal.alias("baseline_cloud_span_count"),
        F.when(automated, "automation").otherwise("human").alias("principal_class"),
        *[total.alias(f"decayed_sum{name}") for name, total in decayed.items()],
    )
    per_cloud = F.when(F.col("principal_class") == "human", params.per_cloud_multiplier).otherwise(
        params.automation_cloud_multiplier
    )
    out = out.withColumn("__mult", F.pow(per_cloud, F.col("novel_cloud_span_count")))
    if signals:
        risks = {name: params.baseline + F.col("__mult") * F.col(f"decayed_sum{name}") for name in anomalies}
        return out.withColumns({f"scaled_score{n}": F.round(r / (r + 1.0), 4) for n, r in risks.items()}).drop("__mult")
    out = out.withColumn("__risk", params.baseline + F.col("__mult") * F.col("decayed_sum"))
    out = out.withColumn("__scaled", F.col("__risk") / (F.col("__risk") + 1.0))
    return out.withColumns(
        {
            "diversity_multiplier": F.round("__mult", 4),
            "risk_intensity": F.round("__risk", 6),
            "scaled_score": F.round("__scaled", 4),
            "is_critical": F.col("__scaled") >= params.alert_threshold,
            "dominant_signal": dominant_signal(
                F.col("__risk"), F.col("novel_cloud_span_count"), F.col("decayed_sum"),
                params.baseline,
            ),
            "trust_score": trust_score(F.round("__scaled", 4)),
        }
    ).drop("__mult", "__risk", "__scaled")


def dominant_signal(risk: Column, novel: Column, decayed: Column, baseline: float) -> Column:
    return (
        F.when(risk <= baseline * 1.5, "baseline_only")
        .when(novel >= 1, "cross_cloud_diversity")
        .when(decayed > baseline * 5, "high_event_volume")
        .otherwise("recent_activity_accumulation")
    )


def trust_score(scaled: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - scaled)))


RESULT_FIELDS = (
    "risk_intensity", "scaled_score", "cloud_span_count", "window_cloud_span_count",
    "novel_cloud_span_count", "baseline_cloud_span_count", "active_clouds",
    "diversity_multiplier", "principal_class", "is_critical", "dominant_signal",
)


def as_struct(scored: DataFrame, name: str = "risk") -> DataFrame:
    """Fold the result columns into one struct column."""
    rest = [c for c in scored.columns if c not in RESULT_FIELDS]
    return scored.select(*rest, F.struct(*RESULT_FIELDS).alias(name))


def isolated(df: DataFrame, params: RiskParams = RiskParams(), **kw) -> DataFrame:
    """Every event scored as an entity of its own: no stitching and no shuffle."""
    ptype = F.upper("principal_type") if "principal_type" in df.columns else F.lit("")
    agent = [F.nullif(F.col(c), F.lit("")) for c in ("ua_family", "user_agent") if c in df.columns]
    hinted = agents.automation_hint(F.coalesce(*agent) if agent else F.lit(""))
    automated = F.coalesce(ptype.isin(*agents.RISK_AUTOMATION_TYPES), F.lit(False)) | hinted
    risk = params.baseline + clean_anomaly(df)
    cloud = _known_cloud()
    span = F.when(cloud.isNull(), 0).otherwise(1)
    return df.withColumns(
        {
            "active_clouds": F.array_compact(F.array(cloud)),
            "cloud_span_count": span,
            "window_cloud_span_count": span,
            "novel_cloud_span_count": F.lit(0),
            "baseline_cloud_span_count": F.lit(0),
            "principal_class": F.when(automated, "automation").otherwise("human"),
            "diversity_multiplier": F.lit(1.0),
            "risk_intensity": F.round(risk, 6),
            "scaled_score": F.round(risk / (risk + 1.0), 4),
            "is_critical": risk / (risk + 1.0) >= params.alert_threshold,
            "dominant_signal": dominant_signal(
                risk, F.lit(0), clean_anomaly(df), params.baseline
            ),
            "trust_score": trust_score(F.round(risk / (risk + 1.0), 4)),
        }
    )


def contributions(
    df: DataFrame,
    params: RiskParams = RiskParams(),
    *,
    entity: str = "entity_id",
    ts: str = "timestamp",
    order: str = "event_id",
) -> DataFrame:
    """What each active event adds to the entity's latest risk, one row per event.

    Evaluated once per entity, so the result never exceeds the input.
    """
    principal = F.col("principal") if "principal" in df.columns else F.lit("")
    base = df.select(
        entity, order,
        principal.alias("principal"),
        events.normalize_cloud(F.col("source_cloud")).alias("source_cloud"),
        clean_anomaly(df).alias("__a"),
        events.micros(F.col(ts)).alias("__t"),
    )
    last = base.groupBy(F.col(entity).alias("__entity")).agg(F.max("__t").alias("__now"))
    age = (F.col("__now") - F.col("__t")) / events.MICROS
    weight = decay(age, params.half_life_seconds)
    return (
        base.join(last, F.col(entity) == F.col("__entity"))
        .where(F.col("__now") - F.col("__t") <= params.window_us)
        .select(
            entity, order, "principal", "source_cloud",
            F.round("__a", 4).alias("anomaly_score"),
            F.round(age, 2).alias("age_seconds"),
            F.round(weight, 4).alias("weight"),
            F.round(F.col("__a") * weight, 6).alias("contribution"),
        )
    )


def nearest_rank_threshold(
    df: DataFrame,
    column: str = "risk_intensity",
    percentile: float = 95.0,
    cap: float = 0.999,
) -> DataFrame:
    """One row: the scaled benign score at rank min(floor(n p / 100), n - 1), from 0."""
    if not 0 < percentile <= 100:
        raise ValueError("percentile must lie in (0, 100]")
    value = events.finite(F.col(column), 0.0)
    counted = cut_lineage(
        df.select((value / (value + 1.0)).alias("scaled"))
        .groupBy("scaled")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = ordered.global_prefix(counted, "scaled", {"upto": "n"}, stored=True)
    size = counted.agg(F.sum("n")).scalar()
    wanted = F.least(F.floor(size * percentile / 100.0), size - 1)
    return ranked.where(F.col("upto") > wanted).agg(
        F.round(F.least(F.lit(cap), F.min("scaled")), 4).alias("threshold"),
        F.max("upto").alias("n_benign"),
    )


def approximate_threshold(
    df: DataFrame, column: str = "risk_intensity", percentile: float = 95.0, accuracy: int = 10_000
) -> DataFrame:
    """One-pass approximation of ``nearest_rank_threshold`` for very wide data."""
    value = events.finite(F.col(column), 0.0)
    return df.agg(
        F.round(
            F.least(F.lit(0.999), F.percentile_approx(value / (value + 1.0), percentile / 100.0, accuracy)),
            4,
        ).alias("threshold"),
        F.count(F.lit(1)).alias("n_benign"),
    )


def merge_footprints(*tables: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Union of recorded baselines per entity."""
    united = reduce(DataFrame.unionByName, [t.select(entity, "clouds") for t in tables])
    return (
        united.select(entity, F.explode("clouds").alias("cloud"))
        .groupBy(entity)
        .agg(F.array_sort(F.collect_set("cloud")).alias("clouds"))
    )
