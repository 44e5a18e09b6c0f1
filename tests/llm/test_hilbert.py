"""Hilbert sharding: the curve itself, the laws, and what it saves a reader."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from auditweave.llm import hilbert, queries
from auditweave.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, place int"


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 1), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_every_cell_step_by_step(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    frame = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    found = frame.select("*", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits).alias("at")).collect()
    path = {r["at"]: tuple(r)[:n] for r in found}
    assert sorted(path) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(path[i], path[i + 1])) == 1 for i in range(len(cells) - 1))


def rows_with_everything():
    rows = [(i, "same text" * 3, "en", "hot", 0, 9, "own", 9) for i in range(200)]  # a third are copies
    rows += [(200 + i, f"text {i} " * (i % 50), ("de", "fr", None)[i % 3], f"s{i % 11}", 0, 9, "own", 9) for i in range(390)]
    rows += [(5, "same text" * 3, "en", "hot", 0, 9, "own", 9)] * 7  # repeated rows
    rows += [(None, None, None, None, None, None, None, None), (900, "", "en", None, 0, 9, "", 9), (901, "é😀" * 500_000, "en", "x", 0, 9, "", 9)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_with_everything(), SCHEMA).repartition(5)


def test_rows_law(frame):
    found = hilbert.shard_table(frame).collect()
    want = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_with_everything()}
    assert len(found) == 600 and {(r.doc_id, r["size"], r.text_crc32) for r in found} == want
    counts = [sum(r.shard == s for r in found) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 600
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in found)
    copies = [(r.shard, r.slot) for r in ordered if r["size"] == 28 and r.text_crc32 == zlib.crc32(b"same text" * 3)]
    first = ordered.index(next(r for r in ordered if (r.shard, r.slot) == copies[0]))
    assert len(copies) == 207 and [(r.shard, r.slot) for r in ordered[first : first + 207]] == copies


def test_bytes_law_and_columns_kept(frame):
    small = frame.where("doc_id < 900 or doc_id is null").withColumn("bytes", F.length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    found = hilbert.shard(small, ["lang", "source"], shards=8, law="bytes", size="bytes", ties=["doc_id"])
    assert sorted(found.columns) == sorted({*small.columns, "curve"}) and found.count() == small.count()
    totals = [r.b for r in found.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    largest = max(r.bytes for r in small.collect())
    assert len(totals) == 8 and max(abs(t - sum(totals) / 8) for t in totals) <= largest
    with pytest.raises(ValueError):
        hilbert.shard(small, ["lang"], law="bytes")


def test_cuts_are_quantiles(spark):
    frame = spark.createDataFrame([(i % 100,) for i in range(1_000)] + [(None,)] * 24, "v int")
    cuts = hilbert.quantile_cuts(frame, "v", 2)
    values = sorted([-1] * 24 + [i % 100 for i in range(1_000)])
    assert cuts == [values[1_024 * j // 4] for j in (1, 2, 3)]
    cells = {r.v: r.c for r in frame.select("v", hilbert.cell_of("v", cuts).alias("c")).distinct().collect()}
    assert cells[None] == 0 and all(cells[v] == sum(v >= c for c in cuts) for v in range(100))


def test_empty_table_and_one_shard(spark, frame):
    assert hilbert.shard_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.shard for r in hilbert.shard_table(frame, shards=1).collect()} == {0}


def test_written_files_prune_on_every_dimension(spark):
    n = 4_096
    frame = spark.range(n).select("id", (F.col("id") % 64).alias("a"), F.shiftright("id", 6).alias("b"))
    path = shared_path(spark, "hilbert-test")
    hilbert.write_shards(hilbert.shard(frame, ["a", "b"], shards=64, ties=["id"]), path)
    written = spark.read.parquet(path)
    files = hilbert.manifest(written, ["a", "b"])
    rows = [r.asDict() for r in files.collect()]
    assert written.count() == n == sum(r["n_rows"] for r in rows) and len(rows) >= 64
    for column in ("a", "b"):  # a sort by one column would leave the other unpruned
        kept = hilbert.files_for(files, {column: (3, 4)})
        share = kept.agg(F.sum("n_rows")).first()[0] / n
        assert share <= 0.25
        names = {r.file for r in kept.collect()}
        needed = {r.f for r in written.where(F.col(column).between(3, 4)).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
        assert needed <= names


def test_query_keeps_the_rows_law_without_python(spark, sf_dir):
    found = queries.op13_shards(spark, sf_dir)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(16))
    assert sorted(tuple(r) for r in queries.op13_shards(spark, sf_dir).select("doc_id", "shard", "slot").collect()) == sorted(
        (r.doc_id, r.shard, r.slot) for r in rows)
