"""The state log against tables kept whole, with merges, deletions and repeated batches."""

import random

import pytest
from helpers import by
from pyspark.sql import functions as F

from auditweave.operators import identity
from auditweave.sources import sinks
from auditweave.streaming import flows, state_log
from test_identity import SCHEMA as ID_SCHEMA
from test_identity import compare, random_events, replay

TABLES = {
    "owner": state_log.Table("key string, entity_id string", "key", {"entity_id": state_log.newest}),
    "clouds": state_log.Table("entity_id string, clouds array<string>", "entity_id", {"clouds": state_log.united}),
}


@pytest.mark.parametrize("fan", [2, 3, 4])
def test_runs_cover_every_batch_once(fan):
    for version in range(200):
        runs = state_log.runs_before(version, fan)
        assert [x for low, high in runs for x in range(low, high)] == list(range(version))
        sizes = [high - low for low, high in runs]
        assert sizes == sorted(sizes, reverse=True) and all(sizes.count(s) < fan or s == max(sizes) for s in set(sizes))


def test_reads_equal_tables_kept_whole(spark, tmp_path):
    rng = random.Random(4)
    log = state_log.StateLog(str(tmp_path / "log"), TABLES, fan=2)
    assert log.read(spark, 0) is None
    owner, clouds = {}, {}
    for version in range(9):
        log.forget(spark, version)
        news = {f"k{rng.randrange(12)}": f"e{version}-{rng.randrange(3)}" for _ in range(4)}
        seen = {e: sorted(rng.sample(["AWS", "AZURE", "GCP"], rng.randint(0, 2))) for e in set(news.values()) | set(rng.sample(sorted(clouds), min(2, len(clouds))))}
        gone = set(rng.sample(sorted(clouds), 1)) - set(seen) if version in (3, 6) else set()
        frames = {
            "owner": spark.createDataFrame(list(news.items()), TABLES["owner"].schema),
            "clouds": spark.createDataFrame(list(seen.items()), TABLES["clouds"].schema),
        }
        marked = spark.createDataFrame([(g,) for g in gone], "entity_id string")
        for _ in range(1 + (version % 3 == 1)):  # some batches are run twice
            log.write(spark, version, frames, marked)
        owner |= news
        for e, c in seen.items():
            clouds[e] = sorted({*clouds.get(e, []), *c})
        clouds = {e: c for e, c in clouds.items() if e not in gone}
        owner = {k: e for k, e in owner.items() if e not in gone}
        got = log.read(spark, version + 1)
        assert {r.key: r.entity_id for r in got["owner"].collect()} == owner
        assert {r.entity_id: r.clouds for r in got["clouds"].collect()} == clouds
    folders = sorted(p.name for p in (tmp_path / "log" / "owner").iterdir())
    assert folders == ["run-0-8", "run-8-9"]


def test_a_batch_writes_its_own_changes_and_can_be_repeated(spark, tmp_path):
    data = sorted(random_events(41, n=160, people=60, fed=0.04, made=0.1), key=lambda e: (e[1], e[0]))
    frame = spark.createDataFrame(data, ID_SCHEMA).withColumn("anomaly_score", F.lit(0.5))
    job = flows.IdentityStream(str(tmp_path / "out"), fan=2)
    for n in range(4):
        ids = [e[0] for e in data[40 * n : 40 * (n + 1)]]
        batch = frame.where(F.col("event_id").isin(ids))
        for _ in range(1 + (n == 2)):
            job.process(batch, n)
        for name in state_log.IDENTITY_TABLES:
            written = spark.read.schema(state_log.IDENTITY_TABLES[name].schema).parquet(str(tmp_path / f"out/state/{name}/run-{n}-{n + 1}"))
            assert written.count() <= 2 * 40  # keys of a batch: a principal and a federation key per event
    done = spark.read.parquet(str(tmp_path / "out/scored")).drop("batch_id")
    compare(identity.Resolution(done, None), replay(data))
    latest = sinks.read_latest(spark, str(tmp_path / "out/risk_state"), "entity_id", ["timestamp", "event_id"])
    assert latest.count() == done.select("entity_id").distinct().count()
    state = job.state(spark, 4)
    assert state.anchors.count() == done.where("is_new").count()
    assert by(state.activity, "entity_id").keys() == {r.entity_id for r in done.select("entity_id").distinct().collect()}


def test_idle_entities_are_marked(spark, tmp_path):
    data = sorted(random_events(7, n=60, people=30), key=lambda e: (e[1], e[0]))
    frame = spark.createDataFrame(data, ID_SCHEMA).withColumn("anomaly_score", F.lit(0.5))
    job = flows.IdentityStream(str(tmp_path / "out"), max_idle_seconds=3_600.0, fan=2)
    for n in range(2):
        job.process(frame.where(F.col("event_id").isin([e[0] for e in data[30 * n : 30 * (n + 1)]])), n)
    now = data[-1][1].timestamp()
    state = job.state(spark, 2)
    assert all(now - r.end_us / 1e6 <= 3_600 for r in state.activity.collect())
    kept = {r.entity_id for r in state.activity.collect()}
    assert {r.entity_id for r in state.identity.collect()} <= kept and {r.entity_id for r in state.anchors.collect()} <= kept
