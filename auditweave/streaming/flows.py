"""Structured Streaming versions of ingest, features, alert counts and stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

from auditweave.functions import events
from auditweave.operators import features, identity, monitor, normalize, risk
from auditweave.session import ship_by_value
from auditweave.sources import sinks
from auditweave.streaming import state_log, user_state

ship_by_value(user_state)


# --------------------------------------------------------------------- ingest

def raw_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines arriving as files, unparsed, in ``raw``."""
    reader: DataStreamReader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).where(F.trim("value") != "").withColumnRenamed("value", "raw")


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000):
    """The same column from a Kafka topic (needs the connector on the class path)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
        .select(F.col("value").cast("string").alias("raw"))
    )


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Already normalized rows arriving as Parquet files."""
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return normalize.bridge(reader.load(path))


def write_normalized(stream: DataFrame, good_path: str, dead_path: str, checkpoint: str, **trigger):
    """Normalize with the batch operator and split good rows from dead letters per batch.

    A batch is parsed once and kept while both outputs are written; they carry the batch id
    and are overwritten by a retried batch.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        parsed = normalize.parse(batch).persist()
        try:
            good, dead = normalize.split(parsed)
            good.drop("raw_log").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            dead.write.mode("overwrite").json(f"{dead_path}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


# ------------------------------------------------------------------- features

def stream_features(stream: DataFrame, ttl_hours: float | None = None) -> DataFrame:
    """Trailing features per user, updated event by event.

    State per user: the events of the last 24 h and the addresses and devices seen so far.
    An event that comes late sees the kept events up to its own time. ``ttl_hours`` also drops the events of users idle that long; it needs a
    continuous trigger, as state expiry keeps an ``availableNow`` query running.
    """
    if ttl_hours is not None and ttl_hours <= 0:
        raise ValueError("ttl_hours must be positive")
    prepared = features.action_features(features.identity_and_network(stream))
    narrow = prepared.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").cast("string").alias("event_id"),
        events.micros(F.col("timestamp")).alias("at"),
        F.col("login_result_success").alias("ok"),
        F.col("is_read_action").alias("reading"),
        (F.col("action_sensitivity_score") >= 3).cast("int").alias("privileged"),
        "resource", "source_ip",
        F.concat_ws("/", "browser_type", "os_type").alias("device"),
    )
    ttl_ms = int(ttl_hours * 3_600_000) if ttl_hours else None
    processor = user_state.UserFeatures(ttl_ms)
    return narrow.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=user_state.OUTPUT,
        outputMode="append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


# ----------------------------------------------------------------- monitoring

def alert_increase(stream: DataFrame, length="5 minutes", slide="1 minute", delay="10 minutes"):
    """Sliding alert counts; windows close ``delay`` behind the newest event."""
    return monitor.alert_increase(stream.withWatermark("timestamp", delay), length, slide)


def ingestion_rate(stream: DataFrame, length_seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    return monitor.ingestion_rate(stream.withWatermark("timestamp", delay), length_seconds)


def campaign_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions per scenario and actor. A stream session also ends at a gap equal to ``gap``."""
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap).alias("w"), "scenario", "actor")
        .agg(F.count(F.lit(1)).alias("n_steps"))
        .select("scenario", "actor", F.col("w.start").alias("first_seen"), "n_steps")
    )


def new_alert_groups(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First alert of each signature; repeats inside the delay are dropped."""
    from auditweave.operators.explain import alert_signature

    return (
        stream.withColumn("signature", alert_signature())
        .withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["signature"])
    )


# ------------------------------------------------------------------ stitching

class IdentityStream:
    """Stitches and scores micro-batches; the state is a log in a shared folder.

    Batch n reads the state before n and writes what it changed (``state_log``), so the
    bytes written follow the batch, and a retried batch starts from the same tables and
    overwrites its own result.
    """

    def __init__(
        self,
        path: str,
        params: identity.StitchParams = identity.StitchParams(),
        risk_params: risk.RiskParams = risk.RiskParams(),
        max_idle_seconds: float | None = None,
        fan: int = 4,
    ):
        self.path, self.params, self.risk_params = path, params, risk_params
        self.max_idle_seconds = max_idle_seconds
        self.log = state_log.StateLog(f"{path}/state", state_log.IDENTITY_TABLES, fan)

    def state(self, spark: SparkSession, version: int) -> identity.StitchState | None:
        tables = self.log.read(spark, version)
        return None if tables is None else identity.StitchState(**tables)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Function for ``foreachBatch``."""
        spark = batch.sparkSession
        self.log.forget(spark, batch_id)
        state = self.state(spark, batch_id)
        resolved = identity.resolve_entities(batch, state, self.params)
        stitched = resolved.events
        prior = state.clouds if state is not None else None
        # Events of the last window before this batch still count into its risk.
        fresh = stitched.withColumn("__fresh", F.lit(True))
        tail = f"{self.path}/tail/v={batch_id}"
        earlier = None
        if state is not None:
            earlier = spark.read.schema(stitched.schema).parquet(tail)
            fresh = fresh.unionByName(earlier.withColumn("__fresh", F.lit(False)))
        scored = risk.score(fresh, params=self.risk_params, prior=prior).where("__fresh")
        scored.drop("__fresh").write.mode("overwrite").parquet(
            f"{self.path}/scored/batch_id={batch_id}"
        )
        done = spark.read.parquet(f"{self.path}/scored/batch_id={batch_id}")
        sinks.upsert_latest(
            done.select("entity_id", "timestamp", "event_id", "risk_intensity", "scaled_score",
                        "cloud_span_count", "is_critical"),
            "entity_id", ["timestamp", "event_id"], f"{self.path}/risk_state", batch_id,
        )
        recent = done.select(*stitched.columns)
        if earlier is not None:  # a batch may be shorter than the window
            recent = recent.unionByName(earlier)
        at = events.micros(F.col("timestamp"))
        newest = recent.agg(F.max(at)).first()[0]
        window = F.lit(True) if newest is None else at >= newest - self.risk_params.window_us
        recent.where(window).write.mode("overwrite").parquet(f"{self.path}/tail/v={batch_id + 1}")

        written = identity.Resolution(done.select(*stitched.columns), resolved.nodes)
        changes = identity.next_state(written, in_time_order=True)
        gone = None
        if self.max_idle_seconds is not None and newest is not None:
            activity = changes.activity if state is None else changes.activity.unionByName(state.activity)
            gone = identity.idle_entities(activity, newest, self.max_idle_seconds)
        self.log.write(spark, batch_id, {name: getattr(changes, name) for name in state_log.IDENTITY_TABLES}, gone)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        ).trigger(**(trigger or {"availableNow": True})).start()


def split_late(batch: DataFrame, watermark_us: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows go to dead letters, entities are never re-resolved."""
    at = events.micros(F.col("timestamp"))
    return batch.where(at >= watermark_us), batch.where(at < watermark_us)
