"""State tables of a stream as a log: a batch writes its changes, a read merges them.

Batch ``n`` writes the run ``[n, n + 1)``. When ``n + 1`` is a multiple of ``fan``, the last
``fan`` runs of one size become one run of the next, and so on: a row is rewritten at most
``log(batches)`` times to the base ``fan``, and a read opens at most ``(fan - 1)`` runs of
each size. Which runs make up the state before a batch follows from its number alone, so a
batch that is run again reads what it read the first time and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION = "__version"


def newest(column: str) -> Column:
    """The value of the latest batch."""
    return F.max_by(column, VERSION)


@dataclass(frozen=True)
class Table:
    """Columns of a state table, its key, and how values of one key merge.

    ``entity`` names the column that tombstones refer to.
    """

    schema: str
    key: str
    merge: dict[str, Callable[[str], Column]]
    entity: str = "entity_id"

    @property
    def columns(self) -> list[str]:
        return [field.split()[0] for field in self.schema.split(", ")]


def runs_before(version: int, fan: int) -> list[tuple[int, int]]:
    """The runs that hold batches 0 to ``version - 1``: as large as possible, in order."""
    runs, low = [], 0
    while low < version:
        size = 1
        while low % (size * fan) == 0 and low + size * fan <= version:
            size *= fan
        runs.append((low, low + size))
        low += size
    return runs


class StateLog:
    """Tables under one path; deleted entities are tombstones in a table of their own."""

    def __init__(self, path: str, tables: dict[str, Table], fan: int = 4):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.path, self.tables, self.fan = path, tables, fan

    def _folder(self, name: str, run: tuple[int, int]) -> str:
        return f"{self.path}/{name}/run-{run[0]}-{run[1]}"

    def _rows(self, spark: SparkSession, name: str, runs: list[tuple[int, int]]) -> DataFrame:
        schema = f"{self.tables[name].schema}, {VERSION} long"
        return spark.read.schema(schema).parquet(*[self._folder(name, r) for r in runs])

    def _gone(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        return spark.read.schema("entity_id string").parquet(*[self._folder("gone", r) for r in runs]).distinct()

    def _merged(self, spark: SparkSession, name: str, runs: list[tuple[int, int]]) -> DataFrame:
        """One row per key; where nothing older is left, rows of deleted entities go.

        Before that they stay, as an older run may hold another row of their key.
        """
        table = self.tables[name]
        merged = self._rows(spark, name, runs).groupBy(table.key).agg(
            *[table.merge[c](c).alias(c) for c in table.columns if c != table.key], F.max(VERSION).alias(VERSION)
        )
        if runs[0][0] > 0:
            return merged
        gone = self._gone(spark, runs).select(F.col("entity_id").alias("__gone"))
        return merged.join(gone, F.col(table.entity) == F.col("__gone"), "left_anti")

    def read(self, spark: SparkSession, version: int) -> dict[str, DataFrame] | None:
        """The tables before batch ``version``; None before the first batch."""
        runs = runs_before(version, self.fan)
        if not runs:
            return None
        return {name: self._merged(spark, name, runs).select(*table.columns) for name, table in self.tables.items()}

    def write(self, spark: SparkSession, version: int, changes: dict[str, DataFrame], gone: DataFrame | None = None) -> None:
        """Write what batch ``version`` changed, then merge the runs that became complete."""
        run = (version, version + 1)
        for name, table in self.tables.items():
            rows = changes[name].select(*table.columns, F.lit(version).cast("long").alias(VERSION))
            rows.write.mode("overwrite").parquet(self._folder(name, run))
        none = spark.createDataFrame([], "entity_id string")
        (none if gone is None else gone.select("entity_id")).write.mode("overwrite").parquet(self._folder("gone", run))
        size = self.fan
        while (version + 1) % size == 0:
            whole = (version + 1 - size, version + 1)
            parts = [(low, low + size // self.fan) for low in range(whole[0], whole[1], size // self.fan)]
            for name, table in self.tables.items():
                self._merged(spark, name, parts).select(*table.columns, VERSION).write.mode("overwrite").parquet(
                    self._folder(name, whole)
                )
            # tombstones are needed as long as there are older runs that may hold the entity
            kept = self._gone(spark, parts) if whole[0] > 0 else none
            kept.write.mode("overwrite").parquet(self._folder("gone", whole))
            size *= self.fan

    def forget(self, spark: SparkSession, version: int) -> None:
        """Delete the runs that batch ``version - 1`` merged; call it when that batch is over."""
        size = self.fan
        while version and version % size == 0:
            part = size // self.fan
            for low in range(version - size, version, part):
                for name in (*self.tables, "gone"):
                    path = spark._jvm.org.apache.hadoop.fs.Path(self._folder(name, (low, low + part)))
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            size *= self.fan


def united(column: str) -> Column:
    """All members of the lists of a key, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def by_end(column: str) -> Column:
    """The value of the session that ends last."""
    return F.max_by(column, F.struct("end_us", "start_us"))


IDENTITY_TABLES = {
    "identity": Table("key string, entity_id string", "key", {"entity_id": newest}),
    "provenance": Table("created string, entity_id string", "created", {"entity_id": newest}),
    "anchors": Table(
        "entity_id string, ua_family string, ua_version string, proxy boolean, kind string, "
        "source_ip string, founded_us long",
        "entity_id",
        {c: newest for c in ("ua_family", "ua_version", "proxy", "kind", "source_ip", "founded_us")},
    ),
    "activity": Table("entity_id string, start_us long, end_us long", "entity_id", {"start_us": by_end, "end_us": by_end}),
    "clouds": Table("entity_id string, clouds array<string>", "entity_id", {"clouds": united}),
}

