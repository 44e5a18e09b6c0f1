"""Every registered query with SQL must return the rows DuckDB returns."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import rows_of

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, db, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


def test_merged_sources_keep_the_order_of_ids_within_a_time(spark, tmp_path, sf_dir):
    once = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 50")
    once.unionByName(once.withColumn("event_id", once["event_id"] + 1000)).write.parquet(f"{tmp_path}/events.parquet")
    events = duckdb.connect()
    events.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["merge_sources_by_time"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(events.execute(ORACLES["merge_sources_by_time"]).fetchall())
