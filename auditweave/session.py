"""Session settings, checkpoint folder and the size check behind every broadcast."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from types import ModuleType

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 1_000_000
TASK_ROWS = 50_000


def build_session(app: str = "auditweave", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on: UTC, AQE and AQE skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC throughout; pin it on a session somebody else made."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="auditweave-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize an iterated table in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting (at most max_rows + 1) rows.

    A larger table is returned without a hint and joins by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def tasks_for(n_rows: int, spark: SparkSession) -> int:
    """Every core, and so many tasks that none has more than ``TASK_ROWS`` rows on average."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores, and tasks that do not grow with the table, for costly work on each row.

    Parts of a stored file follow its size and its row groups, so a few of them can hold
    all rows. Only for tables that are read or checkpointed: they are counted, and asking a
    planned query for its partitions would run its shuffles.
    """
    wanted = tasks_for(df.count(), df.sparkSession)
    if df.rdd.getNumPartitions() < wanted:
        return df.repartition(wanted)
    return df


def ship_by_value(module: ModuleType) -> None:
    """Send a module's functions inside the task, so workers need no installed package."""
    cloudpickle.register_pickle_by_value(module)


def run_together(jobs: Iterable[Callable], workers: int = 4) -> list:
    """Results of independent driver functions whose Spark jobs may overlap."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(wrap(job)) for job in jobs]
        return [f.result() for f in futures]
