"""What the operators share: stored tables, Arrow batches, id filters."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditweave.session import ensure_checkpoint_dir

BATCH_BYTES = 4 << 20
ARROW_ROWS = "1000"
FILTER_BITS = 1 << 24
_BITMAP_BITS = 32_768  # size of one bitmap of bitmap_construct_agg


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    Later plans start from its files, so nothing is computed twice and a lost executor
    costs one task. The files go with the checkpoint folder of the application.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``shared_path`` that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts are long, so Arrow batches of this session hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column of the input has that name."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def kept_beside(columns: Iterable[str], *outputs: str) -> list[str]:
    """The columns that stay when columns of these names are added: an output replaces its namesake."""
    added = {c.lower() for c in outputs}
    return [c for c in columns if c.lower() not in added]


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def kept_in_worker(name: str, make: Callable):
    """An object that a Python worker builds once and keeps for its later tasks.

    Functions sent to workers arrive with fresh globals for every task; the holder is a
    module entry of the worker process. Only for caches: losing it costs time alone.
    """
    holder = sys.modules.setdefault("_kept_in_worker", ModuleType("_kept_in_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def rows_of(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    """Rows as tuples of Python values, one slice of a batch at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield from zip(*[c.slice(at, step).to_pylist() for c in columns])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 2,000 rows or about ``BATCH_BYTES``, whichever comes first."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > BATCH_BYTES or len(held) >= 2_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _marked(df: DataFrame, key: Column, listed: DataFrame, column: str, bits: int) -> DataFrame:
    """``df`` with ``__hit``: whether the key's bit is set in the bitmap of ``listed``."""
    bitmap = (
        listed.select(_bit(F.col(column), bits).alias("__bit"))
        .groupBy(F.floor(F.col("__bit") / _BITMAP_BITS).alias("__part"))
        .agg(F.bitmap_construct_agg(F.col("__bit") % _BITMAP_BITS).alias("__map"))
    )
    marked = df.withColumn("__own", _bit(key, bits)).withColumn("__part", F.floor(F.col("__own") / _BITMAP_BITS))
    inside = F.col("__own") % _BITMAP_BITS
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = F.coalesce(F.getbit(byte.cast("int"), (inside % 8).cast("int")) == 1, F.lit(False))
    joined = marked.join(F.broadcast(bitmap), "__part", "left")
    return joined.withColumn("__hit", hit).drop("__part", "__own", "__map")


def probably_listed(df: DataFrame, key: Column, listed: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be in ``listed``: a bitmap of fixed size instead of a shuffle.

    The bitmap has ``bits`` bits (2 MB by default, whatever the input) and is broadcast.
    It never loses a listed row; rows that share a bit by chance stay and must be removed
    by the exact join that follows, which then shuffles little.
    """
    return _marked(df, key, listed, column, bits).where(F.col("__hit")).drop("__hit")


def without(df: DataFrame, key: Column, listed: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key is not in ``listed``; only rows that may be listed are shuffled."""
    marked = _marked(df, key, listed, column, bits)
    name = free_name([*df.columns, column], "__key")
    doubtful = marked.where(F.col("__hit")).withColumn(name, key)
    gone = listed.select(F.col(column).alias("__listed")).distinct()
    kept = doubtful.join(gone, F.col(name) == F.col("__listed"), "left_anti")
    return marked.where(~F.col("__hit")).select(*[f"`{c}`" for c in df.columns]).unionByName(
        kept.select(*[f"`{c}`" for c in df.columns])
    )
