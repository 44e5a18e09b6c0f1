"""Most frequent value of a closed trailing window, for any number of values.

Counts of one value rise and fall, so their maximum has no running aggregate; with a column
per value it has, but then their number must be bounded. Here a task streams through the
events of an entity in time order and keeps the window: places per value, and a heap of
(count, first place) entries of which those that are out of date are skipped. Time is cut
into slices of one window; a slice begins with the events of the slice before it, so an
entity's history is many tasks, and memory holds one window.
"""

from __future__ import annotations

import heapq
import sys
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.session import ship_by_value

ship_by_value(sys.modules[__name__])


class Window:
    """Values of one window; ties go to the value whose first active event is earliest."""

    def __init__(self, width: int):
        self.width = width
        self.rows: deque = deque()
        self.places: dict[str, deque] = {}
        self.heap: list = []

    def add(self, at, order, value) -> None:
        if value is not None:
            self.rows.append((at, value))
            self.places.setdefault(value, deque()).append((at, order))
            self._note(value)

    def expire(self, now) -> None:
        while self.rows and self.rows[0][0] < now - self.width:
            _, value = self.rows.popleft()
            self.places[value].popleft()
            if self.places[value]:
                self._note(value)
            else:
                del self.places[value]

    def _note(self, value) -> None:
        places = self.places[value]
        heapq.heappush(self.heap, (-len(places), places[0], value))

    def mode(self):
        while self.heap:
            count, first, value = self.heap[0]
            places = self.places.get(value)
            if places and -len(places) == count and places[0] == first:
                return value
            heapq.heappop(self.heap)
        return None


def running_mode(df: DataFrame, entity: str, at: str, order: str, value: Column, width: int, name: str = "mode") -> DataFrame:
    """(entity, at, order, name): for each event the most frequent value in [at - width, at].

    Events at one time follow ``order``; a null value is not counted.
    """
    number = F.floor(F.col(at) / (width + 1)).cast("long")
    rows = df.where(F.col(at).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(at).alias("at"), F.col(order).alias("place"), value.alias("value"), number.alias("__n")
    )
    copies = F.array(
        F.struct(F.col("__n").alias("slice"), F.lit(True).alias("own")),
        F.struct((F.col("__n") + 1).alias("slice"), F.lit(False).alias("own")),
    )
    placed = rows.select("entity", "at", "place", "value", F.explode(copies).alias("c")).select(
        "entity", "c.slice", "at", "place", "value", "c.own"
    )
    sorted_rows = placed.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "at", "place")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"entity {kinds['entity']}, at {kinds['at']}, place {kinds['place']}, mode string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            kept, modes = [], []
            for i, (who, part, time, place, what, own) in enumerate(zip(*[c.to_pylist() for c in columns])):
                if window is None or (who, part) != current:
                    current, window = (who, part), Window(width)
                window.expire(time)
                window.add(time, place, what)
                if own:
                    kept.append(i)
                    modes.append(window.mode())
            at_rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [columns[0].take(at_rows), columns[2].take(at_rows), columns[3].take(at_rows), pa.array(modes, pa.string())],
                names=["entity", "at", "place", "mode"],
            )

    return sorted_rows.mapInArrow(run, schema).select(
        F.col("entity").alias(entity), F.col("at").alias(at), F.col("place").alias(order), F.col("mode").alias(name)
    )
