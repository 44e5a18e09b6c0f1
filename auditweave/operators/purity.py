"""How well stitched entities agree with ground-truth actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditweave.functions.events import micros
from auditweave.operators import identity, ordered


def entity_purity(
    stitched: DataFrame, actor: str = "gt_principal", y: str = "is_attack"
) -> DataFrame:
    """One row per entity: events, actors, attack and benign counts, clouds, verdict.

    The actors themselves are in ``entity_actors``. Mixed entities come first.
    """
    attack = F.col(y) == 1
    name = F.coalesce(F.col(actor), F.lit("\u0000"))
    rows = stitched.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(name).alias("n_distinct_gt_principals"),
        F.count_if(attack).alias("n_attack_events"),
        F.count_if(~attack).alias("n_benign_events"),
        F.count_distinct("source_cloud").alias("n_clouds"),
    )
    mixed = (F.col("n_attack_events") > 0) & (F.col("n_benign_events") > 0)
    return rows.withColumn(
        "purity",
        F.when(F.col("n_distinct_gt_principals") <= 1, "pure")
        .when(mixed, "mixed-label")
        .otherwise("mixed-principal"),
    )


def worst_first(purity: DataFrame) -> DataFrame:
    verdict = F.col("purity")
    return purity.orderBy(
        (verdict != "mixed-label"), (verdict != "mixed-principal"), F.col("n_events").desc(), "entity_id"
    )


def entity_actors(stitched: DataFrame, actor: str = "gt_principal") -> DataFrame:
    return stitched.groupBy("entity_id", F.col(actor).alias("actor")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def wrong_merges(
    resolution: identity.Resolution,
    actor: str = "gt_principal",
    params: identity.StitchParams = identity.StitchParams(),
    *,
    ts: str = "timestamp",
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """Fuzzy merges that bring an actor the entity did not have, with the signals' shares."""
    timed = resolution.events.withColumn("__t", micros(F.col(ts)))
    sliced = ordered.with_slices(timed, ["entity_id"], "__t", hot_rows, slice_us)
    first = ordered.mark_first(sliced, "__t", ["event_id"], {"__new_actor": [actor]}).plain()
    wrong = first.where((F.col("method") == "fuzzy_merge") & F.col("__new_actor"))
    sided = wrong.withColumns({f"e_{n}": c for n, c in identity.attributes(wrong).items()})
    anchors = resolution.nodes.where("founds").select(
        F.col("entity_id").alias("__anchor"),
        *[F.col(n).alias(f"a_{n}") for n in identity.ATTRIBUTES],
    )
    parts = identity.similarity_breakdown(identity.side("e_"), identity.side("a_"), params)
    return sided.join(anchors, F.col("entity_id") == F.col("__anchor")).select(
        "event_id", "entity_id", F.col(actor).alias("merged_actor"), "similarity",
        parts.alias("parts"),
    ).select("event_id", "entity_id", "merged_actor", "similarity", "parts.*")


def signal_blame(wrong: DataFrame) -> DataFrame:
    """Similarity credit per signal over all wrong merges; one row."""
    return wrong.agg(
        F.count(F.lit(1)).alias("wrong_merges"),
        *[F.round(F.coalesce(F.sum(s), F.lit(0.0)), 3).alias(s) for s in ("ua", "proxy", "ip", "type")],
    )


def method_counts(stitched: DataFrame) -> DataFrame:
    return stitched.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
