"""Checks and statistics on labelled corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditweave.functions.events import safe_ratio


def _names(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.nullif(F.col(column), F.lit("")).isNotNull()).select(
        F.col(column).alias("identity")
    ).distinct()


def identity_roles(benign: DataFrame, labels: DataFrame, actor: str = "actor") -> DataFrame:
    """One row per identity: seen in benign data, in attacks, created by an attacker.

    ``labels`` has the actor, ``anomaly_flag`` and optionally ``created``.
    """
    flagged = F.coalesce(F.col("anomaly_flag"), F.lit(False))
    sightings = [
        benign.select(F.col(actor).alias("identity"), F.lit("benign").alias("role")),
        labels.select(
            F.col(actor).alias("identity"), F.when(flagged, "attack").otherwise("benign").alias("role")
        ),
    ]
    if "created" in labels.columns:
        sightings.append(labels.select(F.col("created").alias("identity"), F.lit("created").alias("role")))
    seen = reduce(DataFrame.unionByName, sightings).where(
        F.nullif(F.col("identity"), F.lit("")).isNotNull()
    )

    def has(*roles: str) -> Column:
        return F.max(F.col("role").isin(*roles))

    return seen.groupBy("identity").agg(
        has("benign").alias("in_benign"),
        has("attack", "created").alias("in_attack"),
        has("created").alias("is_created"),
    )


def leaky_identities(benign: DataFrame, labels: DataFrame, actor: str = "actor") -> DataFrame:
    """Attack-only identities that no attacker created; must be empty."""
    return identity_roles(benign, labels, actor).where(
        F.col("in_attack") & ~F.col("in_benign") & ~F.col("is_created")
    ).select("identity")


def assert_no_leak(benign: DataFrame, labels: DataFrame, actor: str = "actor") -> None:
    leaks = leaky_identities(benign, labels, actor)
    if not leaks.isEmpty():
        raise ValueError(f"attack-only identities, such as {leaks.first()['identity']!r}")


def leakage_summary(roles: DataFrame) -> DataFrame:
    only = F.col("in_attack") & ~F.col("in_benign")
    return roles.agg(
        F.count_if("in_benign").alias("benign_identities"),
        F.count_if("in_attack").alias("attack_identities"),
        F.count_if("is_created").alias("created_identities"),
        F.count_if(only & F.col("is_created")).alias("allowed_attack_only"),
        F.count_if(only & ~F.col("is_created")).alias("leaky"),
        F.count_if(F.col("in_attack") & F.col("in_benign")).alias("in_both"),
    )


def anomaly_share(df: DataFrame, group: str = "source_cloud", flag: str = "anomaly_flag") -> DataFrame:
    """Records and percentage of anomalous ones per cloud."""
    hit = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("records"),
        (100.0 * F.count_if(hit) / F.count(F.lit(1))).alias("pct_anomalous"),
    )


def vocabulary_overlap(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """How many distinct values of the first table also occur in the second; one row."""
    a = _names(real, column).withColumn("__a", F.lit(1))
    b = _names(synthetic, column).withColumn("__b", F.lit(1))
    return a.join(b, "identity", "left").agg(
        F.lit(column).alias("field"),
        F.count("__b").alias("shared"),
        F.count(F.lit(1)).alias("real_values"),
    )


def added_values(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """Values only the second table has."""
    return _names(synthetic, column).subtract(_names(real, column)).withColumnRenamed("identity", column)


def corpus_stats(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events, malicious labels and share, techniques, attacks on held-out victims; one row."""
    bad = F.coalesce(F.col("anomaly_flag"), F.lit(False))
    total = events.agg(F.count(F.lit(1)))
    return labels.agg(
        F.count_if(bad).alias("malicious"),
        F.count_distinct(F.nullif(F.col("technique_id"), F.lit(""))).alias("techniques"),
        F.count_if(bad & (F.col("victim_split") == "holdout")).alias("holdout_attacks"),
    ).select(
        total.scalar().alias("total_events"), "malicious",
        (100.0 * F.col("malicious") / total.scalar()).alias("malicious_pct"),
        "techniques", "holdout_attacks",
    )


def collect_labels(*tables: DataFrame) -> DataFrame:
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if united.isEmpty():
        raise ValueError("no labels")
    return united


def value_counts_by_label(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, feature, value, n) over several columns in one pass."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]
        )
    )
    return (
        df.select(F.col(label).alias("label"), pairs.alias("p"))
        .groupBy("label", "p.feature", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def one_rule(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """Precision and recall of every rule "feature equals value" as a detector."""
    counts = value_counts_by_label(df, y, features).groupBy("feature", "value").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("flagged"),
    )
    positives = df.agg(F.count_if(F.col(y) == 1)).scalar()
    return counts.select(
        "feature", "value", "tp", "flagged",
        (F.col("tp") / F.col("flagged")).alias("precision"),
        safe_ratio(F.col("tp"), positives).alias("recall"),
    )


def rule_metrics(df: DataFrame, y: str, rule: Column) -> DataFrame:
    """Precision and recall of one boolean rule; one row."""
    positive = F.col(y) == 1
    hit = F.coalesce(rule, F.lit(False))
    return df.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit).alias("flagged"),
        F.count_if(positive).alias("positives"),
    ).select(
        "tp", "flagged", "positives",
        safe_ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )
