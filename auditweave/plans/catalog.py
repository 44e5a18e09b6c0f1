"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.plans import behaviour, evaluation, models, normalization, stitching  # noqa: F401
from auditweave.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by their latest cross-cloud risk."""
    return QUERIES["latest_risk_per_entity"](spark, sf_dir).orderBy(F.col("scaled_score").desc())
