"""Attributions of a prediction, their deletion test, and what happens to the alert.

Attributions are exact Shapley values of the trees: a feature that is not known goes down
both branches in proportion to their training weight (``leaf_paths``, ``tree_kernel``).
For other models there are sampled ones (Strumbelj and Kononenko 2014): along a random
order the features of a background row are replaced one by one by the event's own, and
each feature is credited with the change it causes. All evaluations of all alerts form
one table that goes through the model once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.operators import leaf_paths, tree_kernel
from auditweave.operators.classifier import PhaseModel, background_medians, probabilities
from auditweave.session import ship_by_value

ship_by_value(tree_kernel)

MANUAL_REVIEW = "Faithfulness gate failed; flagged for manual analyst review."


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def shapley(
    alerts: DataFrame, model: PhaseModel, *, orders: int = 8, seed: int = 42, row_id: str = "event_id"
) -> DataFrame:
    """(row_id, feature index, impact) for every feature of every alert's predicted class.

    Summed over the features, impacts give f(x) minus the mean of f over the background
    rows used. Only ``orders`` background rows reach the driver.
    """
    picked = model.background.orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id").limit(orders)
    rows = [r[0] for r in picked.select(vector_to_array("features")).collect()]
    n = len(model.feature_columns)
    base = F.array(
        *[F.struct(F.lit(m).alias("m"), _doubles(z).alias("z")) for m, z in enumerate(rows)]
    )
    indices = F.sequence(F.lit(0), F.lit(n - 1))
    paths = (
        alerts.select(
            row_id, F.col("predicted_phase_index").alias("__class"),
            vector_to_array("features").alias("__x"), F.explode(base).alias("__b"),
        )
        .select(row_id, "__class", "__x", "__b.m", "__b.z")
        .withColumn(
            "__order",
            F.transform(
                F.array_sort(
                    F.transform(
                        indices,
                        lambda i: F.struct(
                            F.xxhash64(F.col(row_id), F.col("m"), i, F.lit(seed)).alias("h"), i.alias("i")
                        ),
                    )
                ),
                lambda s: s["i"],
            ),
        )
        .withColumn("__rank", F.transform(indices, lambda i: F.array_position("__order", i)))
        .withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    )
    mixed = F.transform(
        "__x",
        lambda v, i: F.when(F.get(F.col("__rank"), i) <= F.col("__step"), v).otherwise(
            F.get(F.col("z"), i)
        ),
    )
    scored = probabilities(
        model,
        paths.select(
            row_id, "__class", "__step", "__order", array_to_vector(mixed).alias("features")
        ),
    )
    p = F.get("probs", F.col("__class"))
    credit = F.array(
        F.struct(F.get("__order", F.col("__step") - 1).alias("i"), p.alias("v")),
        F.struct(F.get("__order", F.col("__step")).alias("i"), (-p).alias("v")),
    )
    return (
        scored.select(row_id, F.explode(credit).alias("c"))
        .where(F.col("c.i").isNotNull())
        .groupBy(row_id, F.col("c.i").alias("feature"))
        .agg((F.sum("c.v") / len(rows)).alias("impact"))
    )


def exact_shapley(alerts: DataFrame, model: PhaseModel, *, row_id: str = "event_id") -> DataFrame:
    """(row_id, impacts): one number per feature for the predicted class, from the leaf paths.

    The sum of the impacts is the score of the class less its expected score
    (``LeafPaths.expected``): probabilities for a forest, margins for boosted trees.
    """
    paths = leaf_paths.of_model(model.classifier)
    n = len(model.feature_columns)
    by_class = []
    for c in range(paths.value.shape[1]):
        own = np.flatnonzero(paths.value[:, c])
        by_class.append((paths.value[own, c], *[a[own] for a in (paths.feature, paths.low, paths.high, paths.share)]))
    rows = alerts.select(
        F.col(row_id).alias("row"), F.col("predicted_phase_index").cast("int").alias("class"), vector_to_array("features").alias("x")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            predicted = batch.column(1).to_numpy(zero_copy_only=False)
            impacts = np.zeros((len(x), n))
            for c in np.unique(predicted):
                at = predicted == c
                impacts[at] = tree_kernel.attributions(x[at], *by_class[c], n)
            offsets = np.arange(0, impacts.size + 1, n, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(impacts.ravel()))], names=["row", "impacts"]
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, impacts array<double>").withColumnRenamed("row", row_id)


def attribute(
    alerts: DataFrame,
    model: PhaseModel,
    *,
    k: int = 3,
    orders: int | None = None,
    seed: int = 42,
    row_id: str = "event_id",
) -> DataFrame:
    """Add ``attributions``: the k features with the largest impact, with their raw value.

    ``orders`` asks for sampled impacts along so many orders instead of exact ones.
    """
    def entry(impact: Column, i: Column) -> Column:
        return F.struct((-F.abs(impact)).alias("o"), i.alias("i"), impact.alias("impact"))

    if orders is None:
        # the impacts of an event are one array already: nothing is exploded or shuffled to rank them
        impacts = exact_shapley(alerts, model, row_id=row_id).select(
            row_id, F.transform("impacts", entry).alias("__all")
        )
    else:
        impacts = shapley(alerts, model, orders=orders, seed=seed, row_id=row_id).groupBy(row_id).agg(
            F.collect_list(entry(F.col("impact"), F.col("feature"))).alias("__all")
        )
    names = F.array(*[F.lit(c) for c in model.feature_columns])
    top = impacts.select(row_id, F.slice(F.sort_array("__all"), 1, k).alias("__top"))
    present = [c for c in model.feature_columns if c in alerts.columns]
    raw = F.create_map(
        *[v for c in present for v in (F.lit(c), F.col(c).cast("string"))]
    ) if present else F.create_map().cast("map<string,string>")
    entries = F.transform(
        "__top",
        lambda s: F.struct(
            F.get(names, s["i"]).alias("key"),
            F.struct(
                F.coalesce(F.try_element_at(F.col("__raw"), F.get(names, s["i"])), F.lit("Unknown")).alias(
                    "raw_value"
                ),
                F.round(s["impact"], 4).alias("impact"),
            ).alias("value"),
        ),
    )
    return (
        alerts.withColumn("__raw", raw)
        .join(top.withColumnRenamed(row_id, "__id"), F.col(row_id) == F.col("__id"), "left")
        .withColumn("attributions", F.map_from_entries(entries))
        .drop("__raw", "__id", "__top")
    )


def faithfulness(
    alerts: DataFrame,
    model: PhaseModel,
    *,
    delta: float = 0.15,
    trials: int = 3,
    seed: int = 1337,
    row_id: str = "event_id",
) -> DataFrame:
    """Add ``passed_gate``: does deleting the attributed features hurt enough?

    Deleting sets a feature to its background median. The confidence must drop by
    ``delta`` and by more than the mean drop over equally large random sets of other
    features. Anything missing fails the gate.
    """
    if model.background is None:
        return alerts.withColumns(
            {"attributed_drop": F.lit(None).cast("double"), "control_drop": F.lit(None).cast("double"),
             "passed_gate": F.lit(False)}
        )
    medians = background_medians(model.background)
    names = F.array(*[F.lit(c) for c in model.feature_columns])
    n = len(model.feature_columns)
    indices = F.sequence(F.lit(0), F.lit(n - 1))
    named = F.filter(
        indices, lambda i: F.array_contains(F.map_keys("attributions"), F.get(names, i))
    )
    ready = alerts.where(
        F.col("attributions").isNotNull() & F.col("features").isNotNull()
    ).select(
        row_id, F.col("predicted_phase_index").alias("__class"),
        F.col("phase_confidence").alias("__conf"),
        vector_to_array("features").alias("__x"), named.alias("__named"),
    ).where(F.size("__named") > 0)
    tried = ready.withColumns(
        {"__k": F.least(F.size("__named"), n - F.size("__named")),
         "__trial": F.explode(F.sequence(F.lit(0), F.lit(trials)))}
    ).withColumn("__draw", F.concat_ws(":", F.col(row_id).cast("string"), F.col("__trial").cast("string")))
    # One expression per feature, which Spark compiles; a lambda over the features would be interpreted.
    others = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.array_contains("__named", F.lit(i)),
                    F.struct(F.md5(F.concat("__draw", F.lit(f":{i}:{seed}"))).alias("h"), F.lit(i).alias("i")),
                )
                for i in range(n)
            ]
        )
    )
    control = F.transform(F.slice(F.sort_array(others), F.lit(1), F.col("__k")), lambda s: s["i"])
    gone = F.when(F.col("__trial") == 0, F.col("__named")).otherwise(control)
    # A set leaves a generator, which evaluates it once: as a plain column it could move into
    # the columns below and be drawn again for every feature.
    variants = tried.select("*", F.explode(F.array(gone)).alias("__gone"))
    kept = F.array(
        *[
            F.when(F.array_contains("__gone", F.lit(i)), F.lit(medians[i])).otherwise(F.get("__x", F.lit(i)))
            for i in range(n)
        ]
    )
    scored = probabilities(
        model,
        variants.select(
            row_id, "__class", "__conf", "__trial", "__k", array_to_vector(kept).alias("features")
        ),
    )
    drop = F.col("__conf") - F.get("probs", F.col("__class"))
    verdict = scored.groupBy(F.col(row_id).alias("__id")).agg(
        F.max(F.when(F.col("__trial") == 0, drop)).alias("attributed_drop"),
        F.coalesce(
            F.avg(F.when((F.col("__trial") > 0) & (F.col("__k") > 0), drop)), F.lit(0.0)
        ).alias("control_drop"),
    )
    passed = (F.col("attributed_drop") >= delta) & (F.col("attributed_drop") > F.col("control_drop"))
    return (
        alerts.join(verdict, F.col(row_id) == F.col("__id"), "left")
        .withColumn("passed_gate", F.coalesce(passed, F.lit(False)))
        .drop("__id")
    )


def route(alerts: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, rows for manual review); a failed gate replaces the text."""
    ok = F.coalesce(F.col("passed_gate"), F.lit(False))
    labelled = alerts.withColumn(
        "narrative", F.when(ok, text).otherwise(F.lit(MANUAL_REVIEW))
    )
    return labelled.where(ok), labelled.where(~ok)


def alert_signature(
    phase: str = "predicted_phase", features: str = "attributions", confidence: str = "phase_confidence"
) -> Column:
    """Hash of phase, sorted feature names and confidence to one decimal."""
    quoted = F.transform(
        F.array_sort(F.map_keys(features)), lambda f: F.concat(F.lit("'"), f, F.lit("'"))
    )
    shape = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.sha2(
        F.concat_ws("|", F.col(phase), shape, F.round(F.col(confidence), 1).cast("string")), 256
    )


def group_alerts(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Alerts with one signature become one group with its size and time span."""
    return (
        alerts.withColumn("signature", alert_signature())
        .groupBy("signature")
        .agg(
            F.count(F.lit(1)).alias("n_alerts"),
            F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen"),
            F.first("predicted_phase").alias("predicted_phase"),
        )
    )
