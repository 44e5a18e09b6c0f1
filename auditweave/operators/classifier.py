"""Threat-category classifier on Spark ML, attack scores and leave-one-group-out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.operators import boosting, evaluate, features
from auditweave.session import broadcast_if_small, cut_lineage, run_together

NORMAL = "Normal"


@dataclass
class PhaseModel:
    """Fitted encoder and classifier with everything needed to apply them later."""

    encoder: PipelineModel
    classifier: PipelineModel | boosting.BoostedTrees
    class_names: list[str]
    feature_columns: list[str]
    background: DataFrame | None = None
    threshold: float | None = None

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        spark = SparkSession.getActiveSession()
        boosted = isinstance(self.classifier, boosting.BoostedTrees)
        if boosted:
            self.classifier.save(spark, f"{path}/classifier")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        spark.createDataFrame(
            [(self.class_names, self.feature_columns, self.threshold, boosted)],
            "class_names array<string>, feature_columns array<string>, threshold double, boosted boolean",
        ).write.mode("overwrite").parquet(f"{path}/settings")
        if self.background is not None:
            self.background.write.mode("overwrite").parquet(f"{path}/background")

    @staticmethod
    def load(spark: SparkSession, path: str, background: bool = True) -> PhaseModel:
        settings = spark.read.parquet(f"{path}/settings").first().asDict()
        return PhaseModel(
            PipelineModel.load(f"{path}/encoder"),
            boosting.BoostedTrees.load(spark, f"{path}/classifier")
            if settings.get("boosted")
            else PipelineModel.load(f"{path}/classifier"),
            list(settings["class_names"]),
            list(settings["feature_columns"]),
            spark.read.parquet(f"{path}/background") if background else None,
            settings["threshold"],
        )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.struct(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = counts.withColumn("__t", totals).select(
        F.col(label).alias("__label"),
        (F.col("__t.n") / (F.col("__t.k") * F.col("__n"))).alias("weight"),
    )
    return df.join(broadcast_if_small(weights, 10_000), F.col(label) == F.col("__label")).drop("__label")


def background_sample(df: DataFrame, n: int = 100, seed: int = 42, row_id: str = "event_id") -> DataFrame:
    """n rows chosen by hash; a top-n, not a sort."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))), row_id).limit(n)


def background_medians(background: DataFrame, vector: str = "features") -> list[float]:
    """Median per feature of the (small) background sample."""
    values = background.select(F.posexplode(vector_to_array(vector)).alias("i", "v"))
    rows = values.groupBy("i").agg(F.median("v").alias("m")).orderBy("i").collect()
    return [float(r["m"]) for r in rows]


def fit_phase(
    df: DataFrame,
    label: str = "threat_category",
    *,
    labeled: bool = True,
    algorithm: str = "forest",
    trees: int = 100,
    depth: int = 6,
    seed: int = 42,
    background_rows: int = 100,
) -> PhaseModel:
    """Fit on feature rows (see ``features.features``) with balanced class weights.

    ``algorithm`` is ``forest`` or ``boosted``, where ``trees`` counts the rounds.
    """
    encoder = features.fit_encoder(df, labeled)
    encoded = features.encode(encoder, df)
    indexer = StringIndexer(
        inputCol=label, outputCol="__class", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(encoded)
    training = cut_lineage(
        balanced_weights(indexer.transform(encoded), label).select(
            "event_id", "features", "__class", "weight"
        )
    )
    if algorithm == "forest":
        stage = RandomForestClassifier(
            labelCol="__class", featuresCol="features", weightCol="weight",
            numTrees=trees, maxDepth=depth, seed=seed,
        )
        fitted = PipelineModel([stage.fit(training)])
    elif algorithm == "boosted":
        fitted = boosting.fit(
            training, "__class", classes=len(indexer.labels), weight="weight", rounds=trees, depth=depth
        )
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    background = cut_lineage(
        background_sample(training.select("event_id", "features"), background_rows, seed)
    )
    return PhaseModel(
        encoder, fitted, list(indexer.labels),
        features.feature_columns(labeled), background,
    )


def probabilities(model: PhaseModel, encoded: DataFrame, output: str = "probs") -> DataFrame:
    """Class probabilities as an array, in the order of ``class_names``."""
    out = model.classifier.transform(encoded)
    probs = vector_to_array("probability")
    return out.withColumn(output, probs).drop("probability", "rawPrediction", "prediction")


def score_phase(
    df: DataFrame, model: PhaseModel | None, fallback: str = "if_anomaly_score"
) -> DataFrame:
    """Phase, confidence and attack score 1 - P(Normal).

    Without a Normal class the isolation-forest score stands in; without a model every
    event gets the neutral constants.
    """
    if model is None:
        return bypass(df)
    out = probabilities(model, features.encode(model.encoder, df))
    best = F.array_max("probs")
    index = F.array_position("probs", best) - 1
    names = F.array(*[F.lit(c) for c in model.class_names])
    out = out.withColumns(
        {
            "predicted_phase_index": index.cast("int"),
            "predicted_phase": F.get(names, index.cast("int")),
            "phase_confidence": F.round(best, 4),
        }
    )
    if NORMAL in model.class_names:
        normal = model.class_names.index(NORMAL)
        attack = F.round(1.0 - F.get("probs", F.lit(normal)), 4)
    else:
        attack = F.col(fallback)
    return out.withColumn("anomaly_score", attack)


def bypass(df: DataFrame) -> DataFrame:
    """Neutral scores for a deployment without models."""
    impact = "map<string,struct<raw_value:string,impact:double>>"
    return df.withColumns(
        {
            "anomaly_score": F.lit(0.1),
            "if_anomaly_score": F.lit(0.1),
            "predicted_phase": F.lit(NORMAL),
            "predicted_phase_index": F.lit(0),
            "phase_confidence": F.lit(0.1),
            "attributions": F.from_json(F.lit("{}"), impact),
        }
    )


def drop_unseen_classes(test: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Keep test rows whose class occurs in training."""
    return test.join(train.select(label).distinct(), label, "left_semi")


def leave_one_group_out(
    attacks: DataFrame,
    benign: DataFrame,
    group: str = "scenario",
    label: str = "threat_category",
    noise: str = "benign_noise",
    **fit_options,
) -> DataFrame:
    """Hold each group out in turn: train on the others plus noise, test on it plus benign.

    There are few groups; their folds are independent Spark jobs that run side by side.
    """
    is_attack = F.col("is_attack") == 1
    groups = [
        r[0]
        for r in attacks.where(is_attack & (F.col(group) != noise)).select(group).distinct().orderBy(group).collect()
    ]

    def fold(held: str) -> DataFrame:
        others = attacks.where(is_attack & ~F.col(group).isin(held, noise))
        negatives = attacks.where(F.col(group) == noise).withColumn(label, F.lit(NORMAL))
        model = fit_phase(others.unionByName(negatives), label, **fit_options)
        unseen = attacks.where(is_attack & (F.col(group) == held)).withColumn("__y", F.lit(1))
        test = unseen.unionByName(benign.withColumn("__y", F.lit(0)), allowMissingColumns=True)
        scored = cut_lineage(
            score_phase(test, model).select("event_id", "__y", "anomaly_score", "predicted_phase")
        )
        curve = evaluate.pr_curve(scored, "anomaly_score", "__y")
        positive = F.col("__y") == 1
        buckets = scored.where(positive).groupBy("predicted_phase").agg(F.count(F.lit(1)).alias("n"))
        top = buckets.orderBy(F.col("n").desc(), "predicted_phase").limit(3).agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "predicted_phase"))),
                    lambda b: F.concat(b["predicted_phase"], F.lit(":"), (-b["m"]).cast("string")),
                ),
                ";",
            )
        )
        flagged = F.count_if(positive & (F.col("predicted_phase") != NORMAL))
        return cut_lineage(
            scored.agg(
                F.lit(held).alias("held_out"),
                F.lit(others.count()).alias("n_train_attack"),
                F.count_if(positive).alias("n_test_attack"),
                F.count_if(~positive).alias("n_test_benign"),
                flagged.alias("flagged_not_normal"),
                (flagged / F.count_if(positive)).alias("flag_rate"),
            ).select(
                "*",
                evaluate.roc_auc(curve).scalar().alias("roc_auc"),
                evaluate.average_precision(curve).scalar().alias("pr_auc"),
                top.scalar().alias("top_buckets"),
            )
        )

    table = reduce(DataFrame.unionByName, run_together(partial(fold, g) for g in groups))
    mean = table.agg(
        F.lit("MEAN").alias("held_out"), F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc")
    )
    return table.unionByName(mean, allowMissingColumns=True)
