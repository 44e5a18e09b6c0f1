"""Readers: provider log files, label tables, reference lists."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.sources.json_arrays import read_json_arrays

CLOUDS = ("AWS", "AZURE", "GCP")
# File name patterns of a split, per kind.
SPLIT_PATTERNS = {"benign": "{cloud}_benign*.json", "attack": "{cloud}_attack.json"}
LABEL_SCHEMA = (
    "event_id string, scenario string, actor string, cloud string, action string, "
    "timestamp timestamp, anomaly_flag boolean, threat_category string, severity_score double, "
    "tactic string, technique_id string, technique_name string, infra string, note string, "
    "victim_split string, created string"
)
RANGE_SCHEMA = "start_ip string, end_ip string, country string, asn_org string"


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever file system the pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return sorted(str(f.getPath()) for f in found) if found else []


def discover_split(spark: SparkSession, base_dir: str, kind: str) -> dict[str, str]:
    """Exactly one file per cloud, or an error that names what was found."""
    paths = {}
    for cloud in CLOUDS:
        pattern = f"{base_dir}/{SPLIT_PATTERNS[kind].format(cloud=cloud.lower())}"
        found = matching_files(spark, pattern)
        if len(found) != 1:
            raise FileNotFoundError(f"expected one {kind} file for {cloud}, found {found}")
        paths[cloud] = found[0]
    return paths


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON record per line, unparsed, in ``raw``."""
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw")


def read_split(spark: SparkSession, base_dir: str, kind: str) -> DataFrame:
    """All records of a split with the cloud their file belongs to."""
    parts = [
        read_json_arrays(spark, path).withColumn("cloud", F.lit(cloud))
        for cloud, path in discover_split(spark, base_dir, kind).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)


def read_ip_list(spark: SparkSession, path: str) -> DataFrame | None:
    """Addresses of a list file without comments and blanks; None when there is no file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    ip = F.trim("value")
    return lines.select(ip.alias("ip")).where((F.col("ip") != "") & ~F.col("ip").startswith("#"))


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANGE_SCHEMA).option("header", True).csv(path)


def merge_sources(*tables: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Union of raw record tables in event-time order (eventTime, else time, else timestamp).

    Records without a time come last.
    """
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    times = F.json_tuple(raw_col, "eventTime", "time", "timestamp").alias("__a", "__b", "__c")
    when = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("__a", "__b", "__c")])
    return (
        united.select("*", times)
        .withColumn("event_time", when)
        .drop("__a", "__b", "__c")
        .orderBy(F.col("event_time").asc_nulls_last())
    )
