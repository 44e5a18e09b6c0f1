"""Campaigns: sessions of one scenario and actor, and how many of them get caught."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditweave.functions.events import MICROS, micros, safe_ratio
from auditweave.operators import evaluate, ordered
from auditweave.session import cut_lineage

BENIGN_NOISE = "benign_noise"
HOUR_US = 3600 * MICROS


def campaign_map(
    labels: DataFrame,
    gap_hours: float = 6.0,
    *,
    ts: str = "timestamp",
    order: str = "event_id",
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """Attack labels with ``campaign_id``; a gap above ``gap_hours`` starts a new campaign."""
    attacks = labels.where(F.col("scenario") != BENIGN_NOISE).withColumn("__t", micros(F.col(ts)))
    numbered = ordered.sessionize(
        attacks, ["scenario", "actor"], "__t", [order], int(gap_hours * HOUR_US),
        hot_rows=hot_rows, slice_us=slice_us,
    )
    name = F.concat_ws("|", "scenario", "actor", F.col("session_no").cast("string"))
    return numbered.withColumn("campaign_id", name).drop("__t")


def campaign_diagnostics(campaigns: DataFrame) -> DataFrame:
    """Number of campaigns, longest pause inside one and shortest pause between two (hours)."""
    hours = F.col("gap_us") / HOUR_US
    firsts = F.col("gap_us").isNull() | F.col("is_break")
    return campaigns.agg(
        F.count_if(firsts).alias("n_campaigns"),
        F.round(F.coalesce(F.max(F.when(~F.col("is_break"), hours)), F.lit(0.0)), 2).alias(
            "max_intra_campaign_gap_h"
        ),
        F.round(F.min(F.when(F.col("is_break"), hours)), 2).alias("min_inter_campaign_gap_h"),
    )


def expect_campaigns(campaigns: DataFrame, expected: int) -> None:
    found = campaign_diagnostics(campaigns).first()["n_campaigns"]
    if found != expected:
        raise ValueError(f"found {found} campaigns, expected {expected}")


def unmapped_attacks(scored: DataFrame, campaigns: DataFrame, y: str = "is_attack") -> DataFrame:
    """Attack events without a label row; anything here means the join key is broken."""
    return scored.where(F.col(y) == 1).join(campaigns.select("event_id"), "event_id", "left_anti")


def campaign_scores(
    scored: DataFrame,
    campaigns: DataFrame,
    score: str = "scaled_score",
    y: str = "is_attack",
    *,
    ts: str = "timestamp",
    check: bool = True,
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """(campaign_id, scenario, event_id, score, step): attack events in step order."""
    if check and not unmapped_attacks(scored, campaigns, y).isEmpty():
        raise ValueError("some attack events have no campaign")
    joined = (
        scored.where(F.col(y) == 1)
        .select("event_id", F.col(score).alias("score"), micros(F.col(ts)).alias("__t"))
        .join(campaigns.select("event_id", "campaign_id", "scenario"), "event_id")
    )
    sliced = ordered.with_slices(joined, ["campaign_id"], "__t", hot_rows, slice_us)
    return (
        ordered.running(sliced, "__t", ["event_id"], {"step": ordered.total(F.lit(1))})
        .plain()
        .select("campaign_id", "scenario", "event_id", "score", F.col("step").cast("long").alias("step"))
    )


def per_campaign(steps: DataFrame, threshold) -> DataFrame:
    """One row per campaign: steps, best score, first step that reaches the threshold."""
    hit = F.col("score") >= evaluate._threshold(threshold)
    return steps.groupBy("campaign_id", "scenario").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max("score").alias("best_score"),
        F.min(F.when(hit, F.col("step"))).alias("first_detect_step"),
    ).withColumn("caught", F.col("first_detect_step").isNotNull())


def campaign_recall(steps: DataFrame, threshold) -> DataFrame:
    """Campaigns caught, recall, median first step and median fraction passed; one row."""
    caught = cut_lineage(per_campaign(steps, threshold))
    passed = caught.withColumn("__part", F.col("first_detect_step") / F.col("n_steps"))
    counts = caught.agg(
        F.count(F.lit(1)).alias("n_campaigns"), F.count_if("caught").alias("campaigns_detected")
    )
    return counts.select(
        "*",
        ordered.exact_median(caught, "first_detect_step").scalar().alias("median_first_detect_step"),
        F.round(ordered.exact_median(passed, "__part").scalar(), 3).alias("median_frac_through"),
        safe_ratio(F.col("campaigns_detected"), F.col("n_campaigns")).alias("campaign_recall"),
    )


def caught_per_scenario(steps: DataFrame, threshold) -> DataFrame:
    return per_campaign(steps, threshold).groupBy("scenario").agg(
        F.count_if("caught").alias("caught"), F.count(F.lit(1)).alias("total")
    )


def campaign_report(
    scored: DataFrame, steps: DataFrame, threshold, score: str = "scaled_score", y: str = "is_attack"
) -> DataFrame:
    """Event rates next to campaign recall and the lift of the second over the first."""
    events_row = evaluate.confusion(scored, score, y, threshold).select(
        "tp", "fp", F.col("precision").alias("event_precision"), F.col("recall").alias("event_recall")
    )
    found = campaign_recall(steps, threshold)
    summary = found.select(F.struct(*found.columns).alias("s")).scalar()
    return events_row.withColumn("__s", summary).select(
        "tp", "fp", "event_precision", "event_recall", "__s.*"
    ).withColumn(
        "campaign_vs_event_recall", safe_ratio(F.col("campaign_recall"), F.col("event_recall"))
    )


def matched_precision(curve: DataFrame, target: float) -> DataFrame:
    """Lowest threshold with enough event precision: recall only falls above it.

    One row; ``reachable`` is false (and the rest NULL) when no threshold has it.
    """
    ok = (F.col("precision") >= target) & (F.col("flagged") > 0)
    point = F.struct("threshold", "precision", "recall", "tp", "fp")
    return curve.agg(F.min_by(point, F.when(ok, F.col("threshold"))).alias("p")).select(
        F.lit(float(target)).alias("precision_target"),
        F.col("p").isNotNull().alias("reachable"),
        "p.*",
    )


def compare_sets(a: DataFrame, b: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Sizes, intersection, union and Jaccard index of two sets of keys; one row."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full")
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & in_b).alias("shared"),
        F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(in_b & ~in_a).alias("only_b"),
        F.count(F.lit(1)).alias("united"),
    ).withColumn(
        "jaccard",
        F.when(F.col("united") > 0, F.col("shared") / F.col("united")).otherwise(F.lit(1.0)),
    )


def set_differences(a: DataFrame, b: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Keys caught by one side only."""
    only_a = a.select(key).subtract(b.select(key)).withColumn("side", F.lit("a"))
    only_b = b.select(key).subtract(a.select(key)).withColumn("side", F.lit("b"))
    return only_a.unionByName(only_b)
