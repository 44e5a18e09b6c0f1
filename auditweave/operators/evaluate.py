"""Threshold sweeps, ranking metrics, confusion counts and the ablation table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.functions.events import safe_ratio
from auditweave.operators import identity, ordered, risk
from auditweave.session import cut_lineage, run_together


def _counts(df: DataFrame, score: str, y: str) -> DataFrame:
    return (
        df.select(F.col(score).cast("double").alias("threshold"), F.col(y).cast("int").alias("__y"))
        .groupBy("threshold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("n_pos"))
    )


def require_both_classes(df: DataFrame, y: str) -> None:
    low, high = df.agg(F.min(F.col(y).cast("int")), F.max(F.col(y).cast("int"))).first()
    if low is None or low == high:
        raise ValueError("a threshold sweep needs rows of both classes")


def pr_curve(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row per distinct score t, counting rows with score >= t.

    Columns: threshold, n, n_pos, flagged, tp, fp, precision, recall, f1, positives, total.
    """
    counts = cut_lineage(_counts(df, score, y))
    both = ordered.global_prefix(
        counts, "threshold", {"flagged": "n", "tp": "n_pos"}, descending=True, stored=True
    )
    totals = counts.agg(F.struct(F.sum("n").alias("total"), F.sum("n_pos").alias("positives")))
    out = both.withColumn("__t", totals.scalar()).select(
        "threshold", "n", "n_pos", "flagged", "tp",
        (F.col("flagged") - F.col("tp")).alias("fp"),
        (F.col("tp") / F.col("flagged")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("__t.positives")).alias("recall"),
        F.col("__t.positives").alias("positives"),
        F.col("__t.total").alias("total"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r + 1e-12)).otherwise(0.0))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, one row."""
    return curve.agg(
        F.sum(safe_ratio(F.col("n_pos"), F.col("positives")) * F.col("precision")).alias("pr_auc")
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Probability that a positive outranks a negative, ties count one half; one row."""
    negatives = F.col("total") - F.col("positives")
    below = negatives - F.col("fp") + (F.col("n") - F.col("n_pos")) / 2
    return curve.agg(
        (F.sum(F.col("n_pos") * below) / F.first(F.col("positives") * negatives)).alias("roc_auc")
    )


def pick_threshold(curve: DataFrame, metric: str = "f1", precision_floor: float = 0.9) -> DataFrame:
    """One row with the chosen operating point; the lowest threshold wins a tie.

    ``precision_floor`` takes the highest recall with enough precision, or the highest
    precision there is when none has enough.
    """
    low = -F.col("threshold")
    if metric == "f1":
        rank = F.struct(F.col("f1"), low)
    elif metric == "precision_floor":
        ok = F.col("precision") >= precision_floor
        rank = F.struct(ok, F.when(ok, F.col("recall")).otherwise(F.col("precision")), low)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    point = F.struct("threshold", "precision", "recall", "f1")
    return curve.agg(
        F.max_by(point, rank).alias("p"),
        F.sum(safe_ratio(F.col("n_pos"), F.col("positives")) * F.col("precision")).alias("pr_auc"),
    ).select("p.*", "pr_auc")


def sweep(df: DataFrame, score: str, y: str, metric: str = "f1", precision_floor: float = 0.9):
    """Operating point and average precision of a labelled table, one row."""
    require_both_classes(df, y)
    return pick_threshold(pr_curve(df, score, y), metric, precision_floor)


def _threshold(value) -> Column:
    """A number, or a one-row table holding ``threshold``."""
    if isinstance(value, DataFrame):
        return value.select("threshold").scalar()
    return F.lit(float(value))


def confusion(df: DataFrame, score: str, y: str, threshold) -> DataFrame:
    """Counts and rates at a frozen threshold, in one aggregate."""
    hit = F.col(score) >= _threshold(threshold)
    positive = F.col(y) == 1
    counts = df.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return counts.select(
        "tp", "fp", "tn", "fn",
        safe_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
        safe_ratio(fp, fp + tn).alias("fpr"),
    )


def flagged_rate(df: DataFrame, score: str, threshold, group: str, where: Column) -> DataFrame:
    """Flagged rows per group: detection rate on attacks, false-positive rate on benign."""
    hit = F.col(score) >= _threshold(threshold)
    return (
        df.where(where)
        .groupBy(group)
        .agg(F.count_if(hit).alias("flagged"), F.count(F.lit(1)).alias("total"))
        .withColumn("rate", F.col("flagged") / F.col("total"))
    )


def base_rate_context(df: DataFrame, score: str, y: str, threshold, ts: str = "timestamp"):
    """Base rate, lift of average precision over it, alerts per day."""
    curve = pr_curve(df, score, y)
    hit = F.col(score) >= _threshold(threshold)
    day = F.to_date(F.col(ts))
    summary = df.agg(
        F.avg(F.col(y).cast("double")).alias("base_rate"),
        F.count_if(hit).alias("alerts"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("days"),
    )
    return summary.withColumn("pr_auc", average_precision(curve).scalar()).select(
        "base_rate", "pr_auc",
        safe_ratio(F.col("pr_auc"), F.col("base_rate")).alias("lift"),
        "alerts", "days",
        (F.col("alerts") / F.col("days")).alias("alerts_per_day"),
    )


# ----------------------------------------------------------------- multi-class

def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(truth).alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col(predicted).alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"),
    )
    p, r = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    return sums.select(
        "class", "support", "tp", p.alias("precision"), r.alias("recall"),
        safe_ratio(2 * p * r, p + r).alias("f1"),
    )


def class_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, classes: list[str] | None = None
) -> DataFrame:
    """Rows are true classes, columns predicted ones."""
    return df.groupBy(truth).pivot(predicted, classes).count().na.fill(0)


# ------------------------------------------------------------------- ablation

SIGNALS = {"iforest": "if_score", "classifier": "clf_score"}
MODES = ("isolated", "graph", "oracle")


def _oracle_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("federation_id", F.coalesce("gt_principal", "principal"))


def stitch_for_evaluation(events: DataFrame, warmup: DataFrame | None, mode: str):
    """(stitched events, baselines): identity learned on the benign warm-up first."""
    prepare = _oracle_keys if mode == "oracle" else (lambda d: d)
    state, clouds = None, None
    if warmup is not None:
        learned = identity.resolve_entities(prepare(warmup))
        state = identity.next_state(learned)
        clouds = cut_lineage(state.clouds)
    resolved = identity.resolve_entities(prepare(events), state)
    return cut_lineage(resolved.events), clouds


def run_mode(
    stitched: DataFrame,
    clouds: DataFrame | None,
    mode: str,
    signal: str,
    params: risk.RiskParams = risk.RiskParams(),
) -> DataFrame:
    scored = stitched.withColumn("anomaly_score", F.col(SIGNALS[signal]))
    if mode == "isolated":
        return risk.isolated(scored, params)
    return risk.score(scored, baselines=clouds, params=params, prior=clouds)


def run_signals(
    stitched: DataFrame,
    clouds: DataFrame | None,
    mode: str,
    signals: Sequence[str],
    params: risk.RiskParams = risk.RiskParams(),
) -> DataFrame:
    """As ``run_mode`` for several signals at once, each in a column ``scaled_score_<column of the signal>``."""
    columns = [SIGNALS[s] for s in signals]
    if mode == "isolated":
        return reduce(
            lambda out, column: risk.isolated(out.withColumn("anomaly_score", F.col(column)), params)
            .withColumnRenamed("scaled_score", f"scaled_score_{column}"),
            columns, stitched,
        )
    return risk.score(stitched, baselines=clouds, params=params, prior=clouds, signals=columns)


def require_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    if not a.join(b, key, "left_semi").isEmpty():
        raise ValueError(f"{what} share {key} values")


def ablation(
    events: DataFrame,
    calibration: DataFrame,
    warmup: DataFrame | None = None,
    calibration_warmup: DataFrame | None = None,
    training: DataFrame | None = None,
    *,
    modes: tuple[str, ...] = MODES,
    signals: tuple[str, ...] = tuple(SIGNALS),
    metric: str = "f1",
    y: str = "is_attack",
) -> DataFrame:
    """One row per signal and mode: threshold swept on ``calibration``, applied to ``events``.

    Stitching and windows do not depend on the signal, so they run once per mode and table.
    """
    for other, what in (
        (warmup, "evaluation events and warm-up"),
        (training, "evaluation and training events"),
    ):
        if other is not None:
            require_disjoint(events, other, "event_id", what)
    if calibration_warmup is not None:
        require_disjoint(
            calibration, calibration_warmup, "event_id", "calibration events and warm-up"
        )
    tables = {("isolated", 0): (events, None), ("isolated", 1): (calibration, None)}
    wanted = [
        (mode, side) for mode in modes if mode != "isolated" for side in (0, 1)
    ]
    sides = ((events, warmup), (calibration, calibration_warmup))
    stitched = run_together(
        partial(stitch_for_evaluation, *sides[side], mode) for mode, side in wanted
    )
    tables |= dict(zip(wanted, stitched, strict=True))

    def scores(key: tuple[str, int]) -> DataFrame:
        return cut_lineage(
            run_signals(*tables[key], key[0], signals).select(y, *[f"scaled_score_{SIGNALS[s]}" for s in signals])
        )

    keys = [(mode, side) for mode in modes for side in (0, 1)]
    scored_tables = dict(zip(keys, run_together(partial(scores, key) for key in keys), strict=True))

    def row(mode: str, signal: str) -> DataFrame:
        scored, tuned = (
            scored_tables[(mode, side)].select(F.col(f"scaled_score_{SIGNALS[signal]}").alias("scaled_score"), y)
            for side in (0, 1)
        )
        point = cut_lineage(sweep(tuned, "scaled_score", y, metric))
        curve = cut_lineage(pr_curve(scored, "scaled_score", y))
        return cut_lineage(
            confusion(scored, "scaled_score", y, point).select(
                F.lit(signal).alias("signal"),
                F.lit(mode).alias("mode"),
                point.select("threshold").scalar().alias("threshold"),
                point.select("f1").scalar().alias("calibration_f1"),
                "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "fpr",
                roc_auc(curve).scalar().alias("roc_auc"),
                average_precision(curve).scalar().alias("pr_auc"),
            )
        )

    rows = run_together(partial(row, mode, signal) for mode in modes for signal in signals)
    return reduce(DataFrame.unionByName, rows)
