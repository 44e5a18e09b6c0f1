"""Time-ordered computations that stay exact and parallel when one key is hot.

A window partitioned by a user, entity or campaign puts every row of that key in
one task. Here each key that owns more than ``hot_rows`` rows is cut into time
slices. What earlier slices contribute is aggregated first (partial sums on the
map side), folded along the slices, and enters each slice as one extra row, so
the large side is shuffled once by (key, slice) and never joined. All other keys
keep a single slice and behave like an ordinary window.

At most ``rows / hot_rows`` keys can be hot, which bounds the one table that is
broadcast here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql import types as T

from auditweave.session import broadcast_if_small, cut_lineage, tasks_for

HOT_ROWS = 2_000_000
SLICE_US = 60 * 1_000_000
SHORT_LIST = 1_000
KEY, HOT, SLICE, CARRY = "__key", "__hot", "__slice", "__carry"
_FIRST = Window.unboundedPreceding


# --------------------------------------------------------------------- slices

@dataclass(frozen=True)
class Sliced:
    """Rows with key, hot flag and slice number; ``any_hot`` tells if slicing happened.

    ``n_rows`` is how many there are, or None if they were not counted.
    """

    df: DataFrame
    any_hot: bool
    slice_us: int
    n_rows: int | None = None

    def with_rows(self, df: DataFrame) -> Sliced:
        return Sliced(df, self.any_hot, self.slice_us, self.n_rows)

    def plain(self) -> DataFrame:
        return self.df.drop(KEY, HOT, SLICE)


def _key_column(df: DataFrame, keys: Sequence[str]) -> Column:
    if len(keys) == 1:
        if isinstance(df.schema[keys[0]].dataType, T.StringType):
            return F.coalesce(F.col(keys[0]), F.lit("\u0000"))
    return F.struct(*[F.col(k) for k in keys])


def with_slices(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    hot_rows: int | None = HOT_ROWS,
    slice_us: int = SLICE_US,
) -> Sliced:
    """Count rows per key (one narrow pass, summed on the map side) and slice the hot ones.

    ``hot_rows=None`` skips the count for input known to have no hot key.
    """
    keyed = df.withColumn(KEY, _key_column(df, keys))
    n_rows, hot = (None, None) if hot_rows is None else _hot_keys(keyed, hot_rows)
    if hot is None:
        return Sliced(
            keyed.withColumns({HOT: F.lit(False), SLICE: F.lit(0).cast("long")}), False, slice_us, n_rows
        )
    flagged = (
        keyed.join(hot, KEY, "left")
        .withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False)))
        .withColumn(SLICE, slice_of(F.col(at), slice_us))
    )
    return Sliced(flagged, True, slice_us, n_rows)


def _hot_keys(keyed: DataFrame, hot_rows: int) -> tuple[int, DataFrame | None]:
    """Number of rows, and the keys with more rows than ``hot_rows`` or None.

    A short list becomes a literal table.
    """
    counted = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    is_hot = F.col("__n") > hot_rows
    n_rows, n_hot = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(is_hot)).first()
    hot = counted.where(is_hot).select(KEY, F.lit(True).alias(HOT))
    if not n_hot:
        return n_rows, None
    if n_hot <= SHORT_LIST:
        return n_rows, F.broadcast(keyed.sparkSession.createDataFrame(hot.collect(), hot.schema))
    return n_rows, broadcast_if_small(cut_lineage(hot))


def by_key(sliced: Sliced, rows: DataFrame) -> DataFrame:
    """Shuffle by key (and slice) into as many tasks as the rows need.

    Partitions of a fixed number, or of a fixed size in compressed bytes, would let the
    sorts of a task grow with the table.
    """
    keys = [KEY, SLICE] if sliced.any_hot else [KEY]
    tasks = tasks_for(sliced.n_rows or 0, rows.sparkSession)
    if tasks > rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition(tasks, *keys)
    return rows.repartition(*keys)


def slice_of(at: Column, slice_us: int) -> Column:
    return F.when(F.col(HOT), F.floor(at / F.lit(slice_us))).otherwise(F.lit(0)).cast("long")


# -------------------------------------------------------------- running folds

@dataclass(frozen=True)
class Fold:
    """An aggregate that can be folded slice by slice."""

    value: Column
    local: Callable[[Column], Column]
    per_slice: Callable[[Column, Column], Column]
    along: Callable[[Column], Column]
    settle: Callable[[Column], Column] = lambda c: c
    many: bool = False


def total(value: Column) -> Fold:
    return Fold(value, F.sum, lambda v, _: F.sum(v), F.sum)


def lowest(value: Column) -> Fold:
    return Fold(value, F.min, lambda v, _: F.min(v), F.min)


def highest(value: Column) -> Fold:
    return Fold(value, F.max, lambda v, _: F.max(v), F.max)


def latest(value: Column) -> Fold:
    """Most recent value that is not NULL."""
    return Fold(
        value,
        lambda v: F.last(v, ignorenulls=True),
        lambda v, seq: F.max_by(v, F.when(v.isNotNull(), seq)),
        lambda v: F.last(v, ignorenulls=True),
    )


def members(value: Column) -> Fold:
    """Set of values seen; for short vocabularies such as cloud names."""
    return Fold(
        value,
        F.collect_set,
        lambda v, _: F.collect_set(v),
        F.collect_list,
        lambda v: F.array_distinct(F.flatten(v)),
        many=True,
    )


def running(
    sliced: Sliced,
    at: str,
    order: Sequence[str],
    folds: dict[str, Fold],
    *,
    peers: bool = False,
    exclusive: bool = False,
) -> Sliced:
    """Fold each key from its first row to the current one.

    ``peers`` includes rows at the same time; otherwise ``order`` breaks ties.
    ``exclusive`` leaves the current row out.
    """
    names = list(folds)
    valued = sliced.df.select("*", *[folds[n].value.alias(f"__v_{n}") for n in names])
    rows = valued.withColumn(CARRY, F.lit(False))
    if sliced.any_hot:
        for piece in _carried(valued, at, order, folds, sliced.slice_us):
            rows = rows.unionByName(
                piece.withColumn(CARRY, F.lit(True)), allowMissingColumns=True
            )
    window = Window.partitionBy(KEY, SLICE)
    if peers:
        window = window.orderBy(at).rangeBetween(_FIRST, Window.currentRow)
    else:
        window = window.orderBy(
            F.col(at), F.col(CARRY).desc(), *[F.col(c) for c in order]
        ).rowsBetween(_FIRST, -1 if exclusive else Window.currentRow)
    out = (
        rows.select("*", *[folds[n].local(F.col(f"__v_{n}")).over(window).alias(n) for n in names])
        .where(~F.col(CARRY))
        .drop(CARRY, *[f"__v_{n}" for n in names])
    )
    return sliced.with_rows(out)


def _carried(
    valued: DataFrame, at: str, order: Sequence[str], folds: dict[str, Fold], slice_us: int
) -> list[DataFrame]:
    """What earlier slices of the hot keys hand to each slice, as rows before its first."""
    names = list(folds)
    seq = F.struct(at, *order)
    per_slice = (
        valued.where(F.col(HOT))
        .groupBy(KEY, HOT, SLICE)
        .agg(*[folds[n].per_slice(F.col(f"__v_{n}"), seq).alias(f"__s_{n}") for n in names])
    )
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(_FIRST, -1)
    gathered = per_slice.select(
        KEY, HOT, SLICE, *[folds[n].along(F.col(f"__s_{n}")).over(before).alias(f"__g_{n}") for n in names]
    )
    carried = gathered.select(
        KEY, HOT, SLICE,
        (F.col(SLICE) * slice_us - 1).cast("long").alias(at),
        *[folds[n].settle(F.col(f"__g_{n}")).alias(f"__v_{n}") for n in names],
    )
    single = [f"__v_{n}" for n in names if not folds[n].many]
    pieces = [carried.select(KEY, HOT, SLICE, at, *single)] if single else []
    for n in names:
        if folds[n].many:
            pieces.append(
                carried.select(KEY, HOT, SLICE, at, F.explode(f"__v_{n}").alias(f"__v_{n}"))
            )
    return pieces


def mark_first(
    sliced: Sliced, at: str, order: Sequence[str], flags: dict[str, Sequence[str]]
) -> Sliced:
    """Per flag: is this the key's first row with these column values (NULL is a value)?

    One shuffle by key and slice serves every flag and whatever follows on the same key.
    """
    rows = sliced.df.withColumn("__mark", F.lit(None).cast("string"))
    for name, columns in flags.items() if sliced.any_hot else ():
        groups = sliced.df.where(F.col(HOT)).groupBy(KEY, HOT, SLICE, *columns).agg(
            F.count(F.lit(1)).alias("__n")
        )
        earlier = F.lag(SLICE).over(Window.partitionBy(KEY, *columns).orderBy(SLICE))
        seen = groups.withColumn("__earlier", earlier).where(F.col("__earlier").isNotNull())
        rows = rows.unionByName(
            seen.select(
                KEY, HOT, SLICE, *columns,
                (F.col(SLICE) * sliced.slice_us - 1).cast("long").alias(at),
                F.lit(name).alias("__mark"),
            ),
            allowMissingColumns=True,
        )
    rows = by_key(sliced, rows)
    for name, columns in flags.items():
        window = (
            Window.partitionBy(KEY, SLICE, *columns)
            .orderBy(F.col(at), *[F.col(c) for c in order])
            .rowsBetween(_FIRST, Window.currentRow)
        )
        counted = F.col("__mark").isNull() | (F.col("__mark") == name)
        rows = rows.withColumn(name, F.count(F.when(counted, 1)).over(window) == 1)
    return sliced.with_rows(rows.where(F.col("__mark").isNull()).drop("__mark"))


# ----------------------------------------------------------- trailing windows

@dataclass(frozen=True)
class TrailingSum:
    """Sum of ``value`` over the half-open interval (t - seconds, t]."""

    seconds: int
    value: Column


@dataclass(frozen=True)
class TrailingDistinct:
    """Distinct values of ``column`` over (t - seconds, t]; NULL counts as one value."""

    seconds: int
    column: str


def trailing(
    sliced: Sliced,
    at: str,
    order: Sequence[str],
    sums: dict[str, TrailingSum],
    distincts: dict[str, TrailingDistinct] | None = None,
) -> DataFrame:
    """Trailing sums and distinct counts, in time linear in the rows.

    Every row adds its value at its own time and takes it back ``seconds`` later, so
    a trailing sum is a running sum over both kinds of rows. For distinct counts a row
    is taken back as soon as the same value occurs again.
    """
    distincts = distincts or {}
    names = [*sums, *distincts]
    payload = [c for c in sliced.df.columns if c not in (KEY, HOT, SLICE)]
    rows = sliced.df
    for name, spec in distincts.items():
        same = Window.partitionBy(KEY, SLICE, spec.column).orderBy(
            F.col(at), *[F.col(c) for c in order]
        )
        rows = rows.withColumn(f"__next_{name}", F.lead(at).over(same))

    def delta(time: Column, amounts: dict[str, Column], is_event: bool) -> Column:
        return F.struct(
            time.cast("long").alias("__at"),
            F.lit(is_event).alias("__event"),
            *[amounts.get(n, F.lit(0)).cast("long").alias(n) for n in names],
        )

    start = {n: s.value for n, s in sums.items()} | {n: F.lit(1) for n in distincts}
    changes = [delta(F.col(at), start, True)]
    by_length: dict[int, dict[str, Column]] = {}
    for name, spec in sums.items():
        by_length.setdefault(spec.seconds, {})[name] = -spec.value
    for seconds, amounts in by_length.items():
        nothing = reduce(lambda a, b: a & b, [v.cast("long") == 0 for v in amounts.values()])
        changes.append(
            F.when(~nothing, delta(F.col(at) + seconds * 1_000_000, amounts, False))
        )
    for name, spec in distincts.items():
        upcoming = F.col(f"__next_{name}")
        end = F.least(upcoming, F.col(at) + spec.seconds * 1_000_000)
        changes.append(
            F.when(
                upcoming.isNotNull() | ~F.col(HOT), delta(end, {name: F.lit(-1)}, False)
            )
        )
    spread = rows.select(
        KEY, HOT,
        F.struct(*payload).alias("__row"),
        F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("__c"),
    ).select(KEY, HOT, F.when(F.col("__c.__event"), F.col("__row")).alias("__row"), "__c.*")

    for name, spec in distincts.items() if sliced.any_hot else ():
        spans = sliced.df.where(F.col(HOT)).groupBy(KEY, HOT, SLICE, spec.column).agg(
            F.min(at).alias("__from"), F.max(at).alias("__to")
        )
        upcoming = F.lead("__from").over(Window.partitionBy(KEY, spec.column).orderBy(SLICE))
        ends = spans.select(
            KEY, HOT,
            F.least(upcoming, F.col("__to") + spec.seconds * 1_000_000).alias("__at"),
            F.lit(False).alias("__event"),
            F.lit(-1).cast("long").alias(name),
        )
        spread = spread.unionByName(ends, allowMissingColumns=True)

    slice_no = slice_of(F.col("__at"), sliced.slice_us) if sliced.any_hot else F.lit(0).cast("long")
    spread = spread.withColumn(SLICE, slice_no).withColumnsRenamed({n: f"__d_{n}" for n in names})
    folded = running(
        sliced.with_rows(spread),
        "__at", [],
        {n: total(F.coalesce(F.col(f"__d_{n}"), F.lit(0))) for n in names},
        peers=True,
    )
    return folded.df.where(F.col("__event")).select("__row.*", *names)


# --------------------------------------------------------------- short windows

@dataclass(frozen=True)
class Recent:
    """Aggregate over a short closed window.

    ``merge`` joins two parts of a window, ``fold`` the aggregates of many parts.
    """

    local: Callable[[Column], Column]
    value: Column
    merge: Callable[[Column, Column], Column]
    fold: Callable[[Column, WindowSpec], Column]
    others_only: bool = False


def recent_sum(value: Column, others_only: bool = False) -> Recent:
    """Sum over the window, without the row itself if ``others_only``."""
    zero = F.lit(0)
    return Recent(
        F.sum, value, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), lambda c, w: F.sum(c).over(w), others_only
    )


def recent_min(value: Column) -> Recent:
    return Recent(F.min, value, F.least, lambda c, w: F.min(c).over(w))


def recent_max(value: Column) -> Recent:
    return Recent(F.max, value, F.greatest, lambda c, w: F.max(c).over(w))


def recent_set(value: Column) -> Recent:
    return Recent(
        F.collect_set, value, F.array_union, lambda c, w: F.array_distinct(F.flatten(F.collect_list(c).over(w)))
    )


def recent(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    window_us: int,
    folds: Callable[[Column], dict[str, Recent]],
    *,
    crowded_rows: int | None = None,
    parts: int = 64,
) -> DataFrame:
    """Aggregate the rows of the closed window [t - window_us, t], ties by ``order``.

    Time is cut into slices one window long and each row is copied into the next
    slice. The window of a row is then a prefix of its own slice plus a suffix of the
    copied one: two one-directional running aggregates, nothing is subtracted, and a
    task never holds more than one key for two window lengths.

    With ``crowded_rows``, slices of a key with more rows are cut into ``parts``: each part
    runs on its own, and what the parts before it (of the slice) and after it (of the copied
    one) add comes from their totals, a few rows per slice.

    ``folds`` receives the slice start, so values can be scaled to a nearby origin.
    """
    width = window_us + 1
    number = F.floor(F.col(at) / width).cast("long")

    def copy(slice_no: Column, time: Column, own: bool) -> Column:
        return F.struct(slice_no.alias(SLICE), time.alias("__at"), F.lit(own).alias("__own"))

    copies = F.array(
        copy(number, F.col(at), True), copy(number + 1, F.col(at) + F.lit(width), False)
    )
    rows = df.select("*", F.explode(copies).alias("__copy")).select(*df.columns, "__copy.*")
    specs = folds(F.col(SLICE) * width)
    crowded = None if crowded_rows is None else _crowded(df, keys, number, crowded_rows)
    group = [*keys, SLICE]
    if crowded is not None:
        part = F.least(F.floor((F.col("__at") - F.col(SLICE) * width) * parts / width), F.lit(parts - 1))
        rows = (
            rows.withColumn(KEY, _key_column(df, keys))
            .join(crowded, [KEY, SLICE], "left")
            .withColumn("__part", F.when(F.col("__crowded"), part).otherwise(0).cast("int"))
        )
        group = [KEY, SLICE, "__part"]
    ascending = (
        Window.partitionBy(*group)
        .orderBy(F.col("__at"), F.col("__own"), *[F.col(c) for c in order])
    )
    descending = (
        Window.partitionBy(*group)
        .orderBy(F.col("__at").desc(), F.col("__own").desc(), *[F.col(c).desc() for c in order])
        .rowsBetween(_FIRST, Window.currentRow)
    )
    halves = []
    for name, spec in specs.items():
        halves.append(
            spec.local(F.when(F.col("__own"), spec.value))
            .over(ascending.rowsBetween(_FIRST, -1 if spec.others_only else 0))
            .alias(f"__a_{name}")
        )
        halves.append(
            spec.local(F.when(~F.col("__own"), spec.value)).over(descending).alias(f"__b_{name}")
        )
    halved = rows.select("*", *halves).where(F.col("__own"))
    if crowded is not None:
        halved = halved.join(_around(rows, specs), group, "left").withColumns(
            {
                f"__{half}_{name}": F.when(F.col("__known").isNull(), F.col(f"__{half}_{name}")).otherwise(
                    spec.merge(F.col(f"__{half}_{name}"), F.col(f"__{half}_around_{name}"))
                )
                for name, spec in specs.items()
                for half in "ab"
            }
        )
    merged = [
        spec.merge(F.col(f"__b_{name}"), F.col(f"__a_{name}")).alias(name)
        for name, spec in specs.items()
    ]
    return halved.select(*df.columns, F.col(SLICE).alias("__window_slice"), *merged)


def _crowded(df: DataFrame, keys: Sequence[str], number: Column, crowded_rows: int) -> DataFrame | None:
    """(key, slice) of slices that hold too many rows as their own or as copies; None if there are none."""
    full = (
        df.groupBy(_key_column(df, keys).alias(KEY), number.alias("__n"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > crowded_rows)
    )
    both = full.select(KEY, F.explode(F.array("__n", F.col("__n") + 1)).alias(SLICE)).distinct()
    both = cut_lineage(both.withColumn("__crowded", F.lit(True)))
    return None if both.isEmpty() else broadcast_if_small(both)


def _around(rows: DataFrame, specs: dict[str, Recent]) -> DataFrame:
    """For each part of a crowded slice, what earlier own and later copied parts add."""
    totals = rows.where(F.col("__crowded")).groupBy(KEY, SLICE, "__part").agg(
        *[spec.local(F.when(F.col("__own"), spec.value)).alias(f"__a_{n}") for n, spec in specs.items()],
        *[spec.local(F.when(~F.col("__own"), spec.value)).alias(f"__b_{n}") for n, spec in specs.items()],
    )
    along = Window.partitionBy(KEY, SLICE).orderBy("__part")
    earlier, later = along.rowsBetween(_FIRST, -1), along.rowsBetween(1, Window.unboundedFollowing)
    return totals.select(
        KEY, SLICE, "__part", F.lit(True).alias("__known"),
        *[spec.fold(F.col(f"__a_{n}"), earlier).alias(f"__a_around_{n}") for n, spec in specs.items()],
        *[spec.fold(F.col(f"__b_{n}"), later).alias(f"__b_around_{n}") for n, spec in specs.items()],
    )


# ------------------------------------------------------------ global prefixes

def global_prefix(
    df: DataFrame,
    order_by: str,
    sums: dict[str, str],
    *,
    descending: bool = False,
    buckets: int = 200,
    stored: bool = False,
    small_rows: int = 100_000,
) -> DataFrame:
    """Running sums over a whole table in the order of one numeric, distinct column.

    Quantile bounds (a constant number of values on the driver) cut the column into
    buckets; each bucket is summed on its own and starts from the total of the buckets
    before it, so no task sees the whole order. Up to ``small_rows`` rows need no bounds.
    ``stored`` says that the table is read or checkpointed already.
    """
    df = df if stored else cut_lineage(df)
    bounds = []
    if df.limit(small_rows + 1).count() > small_rows:
        probabilities = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(df.approxQuantile(order_by, probabilities, 1.0 / (4 * buckets))))
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol=order_by, outputCol="__bucket", handleInvalid="keep"
    ).transform(df.withColumn(order_by, F.col(order_by).cast("double")))

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = bucketed.groupBy("__bucket").agg(
        *[F.sum(source).alias(f"__t_{name}") for name, source in sums.items()]
    )
    before = Window.orderBy(direction("__bucket")).rowsBetween(_FIRST, -1)
    offsets = totals.select(
        "__bucket",
        *[
            F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}")
            for name in sums
        ],
    )
    within = Window.partitionBy("__bucket").orderBy(direction(order_by)).rowsBetween(
        _FIRST, Window.currentRow
    )
    return (
        bucketed.select(
            "*", *[F.sum(source).over(within).alias(f"__w_{name}") for name, source in sums.items()]
        )
        .join(F.broadcast(offsets), "__bucket")
        .select(
            *df.columns,
            *[(F.col(f"__w_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums],
        )
    )


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``: mean of the two middle values, NULLs left out."""
    counted = cut_lineage(
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    last = counted.agg(F.sum("n") - 1).scalar()
    ranked = global_prefix(counted, "v", {"upto": "n"}, stored=True)
    low = F.min(F.when(F.col("upto") > F.floor(last / 2), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil(last / 2), F.col("v")))
    return ranked.agg(((low + high) / 2).alias("median"))


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    gap_us: int,
    *,
    hot_rows: int = HOT_ROWS,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Number the runs of each key; a run ends where the gap is strictly larger.

    Adds ``session_no`` (from 0), ``gap_us`` (to the previous row) and ``is_break``.
    """
    sliced = with_slices(df, keys, at, hot_rows, slice_us)
    gaps = running(sliced, at, order, {"__prev": highest(F.col(at))}, exclusive=True)
    marked = gaps.df.withColumn("gap_us", F.col(at) - F.col("__prev")).withColumn(
        "is_break", F.coalesce(F.col("gap_us") > gap_us, F.lit(False))
    )
    numbered = running(
        gaps.with_rows(marked), at, order, {"session_no": total(F.col("is_break").cast("long"))}
    )
    return numbered.plain().drop("__prev")
