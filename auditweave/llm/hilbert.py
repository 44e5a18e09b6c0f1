"""Sharding along a Hilbert curve, by DataFrame operations only.

Each metadata column is cut at its quantiles into ``2^bits`` cells, the cells of a row give
its place on the curve (J. Skilling, "Programming the Hilbert curve", 2004), rows are sorted
by that place and the sorted run is cut into shards. Rows near each other in all columns at
once lie in the same files, so that minima and maxima of files prune on any of the columns.

Quantiles are exact and computed from counts of distinct values; a row finds its cell by
comparing with at most ``2^bits - 1`` literals. The global order is a range-partitioned sort
with the row's own number as the last key, so copies and frequent values spread over tasks.

Defined cases: null metadata sort first and are in the first cell; null texts have 0 bytes
and the checksum of an empty text; repeated rows are placed one by one; ties on the curve are
ordered by checksum, then by id, then as they are read. An empty table gives no rows. Columns of the
input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditweave.llm.common import slim, stored

BITS = 5
LAWS = ("rows", "bytes")
_IN_PART = 33  # bits that monotonically_increasing_id gives to the place inside a partition


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell given by one number of ``bits`` bits per dimension."""
    n = len(cells)
    if not 0 < n * bits <= 62:
        raise ValueError("dimensions times bits must be between 1 and 62")
    point = F.array(*[c.cast("long") for c in cells])
    steps = [F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, s: Column) -> Column:
        low, own = s["q"] - 1, F.get(x, s["i"])
        on = own.bitwiseAND(s["q"]) != 0
        change = F.when(on, low).otherwise(F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, j: F.when((j == 0) | ((j == s["i"]) & ~on), v.bitwiseXOR(change)).otherwise(v))

    def gray(x: Column) -> Column:
        out, sum_so_far = [], F.lit(0).cast("long")
        for i in range(n):
            sum_so_far = sum_so_far.bitwiseXOR(F.get(x, F.lit(i)))
            out.append(sum_so_far)
        change = F.lit(0).cast("long")
        for b in range(1, bits):
            change = change.bitwiseXOR(F.when(out[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.array(*[v.bitwiseXOR(change) for v in out])

    def interleaved(x: Column) -> Column:
        total = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1))
                total = total + F.shiftleft(bit, b * n + n - 1 - i)
        return total

    turned = F.aggregate(F.array(*steps), point, turn) if steps else point
    # a one-element transform gives each intermediate array a name, so that it is evaluated once
    return F.get(F.transform(F.transform(F.array(turned), gray), interleaved), F.lit(0))


def cumulated(df: DataFrame, order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Adds ``place``, the rows before in the order, and ``before``, the weight of these (rows without ``weight``).

    The sorted table is stored, so both of its readers see the same partitions. Offsets are
    one row per partition.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]
    )
    sorted_rows = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__at", _IN_PART)
    sums = [F.count(F.lit(1)).alias("__rows")] + ([F.sum(weight).alias("__weight")] if weight else [])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sorted_rows.groupBy(part.alias("__part")).agg(*sums).select(
        "__part",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows"),
        *([F.coalesce(F.sum("__weight").over(earlier), F.lit(0)).alias("__weight")] if weight else []),
    )
    inside = F.col("__at").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    rows = sorted_rows.withColumn("__part", part)
    if weight:
        own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    place = F.col("__rows") + inside
    before = F.col("__weight") + F.col("__own") if weight else place
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, place.alias("place"), before.alias("before"))


def quantile_cuts(df: DataFrame, column: str, bits: int) -> list:
    """The distinct values at the quantiles ``j / 2^bits`` of a column, at most ``2^bits - 1``."""
    counted = cumulated(df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), ["v"], "n")
    counted = stored(counted, "values")
    total = counted.agg(F.sum("n")).first()[0] or 0
    targets = sorted({total * j >> bits for j in range(1, 1 << bits)})
    hit = F.exists(F.array(*[F.lit(t).cast("long") for t in targets]), lambda t: t.between(F.col("before"), F.col("before") + F.col("n") - 1))
    return [r[0] for r in counted.where(hit & F.col("v").isNotNull()).orderBy("v").select("v").collect()]


def cell_of(column: str, cuts: Sequence) -> Column:
    """How many cuts a value has reached; 0 for null."""
    if not cuts:
        return F.lit(0)
    reached = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(column) >= c)
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(reached))


def shard(
    df: DataFrame,
    dimensions: Sequence[str],
    *,
    shards: int = 16,
    law: str = "rows",
    size: str | None = None,
    ties: Sequence[str] = (),
    bits: int = BITS,
) -> DataFrame:
    """All rows and columns with ``curve`` (place on the curve), ``shard`` and ``slot`` (from 0 in each shard).

    ``law`` is ``rows`` (row counts at most one apart) or ``bytes`` (sums of the column
    ``size`` near equal: off by one row at each end). ``ties`` order rows of one cell.
    """
    if law not in LAWS or (law == "bytes" and not size):
        raise ValueError(f"law must be one of {LAWS}; bytes needs a size column")
    kept = [c for c in df.columns if c.lower() not in ("curve", "shard", "slot")]
    # the columns travel in one struct, so that no name of theirs meets one made here
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        *[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(dimensions)],
        *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)],
        (F.col(f"`{size}`") if size else F.lit(1)).cast("long").alias("w"),
        F.monotonically_increasing_id().alias("read"),
    )
    cells = [cell_of(f"d{i}", quantile_cuts(keyed, f"d{i}", bits)) for i in range(len(dimensions))]
    placed = keyed.select("row", curve_index(cells, bits).alias("curve"), *[f"t{i}" for i in range(len(ties))], "w", "read")
    order = ["curve", *[f"t{i}" for i in range(len(ties))], "read"]
    numbered = cumulated(placed, order, "w" if law == "bytes" else None)
    totals = placed.agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w")).first()
    if law == "rows":
        number = F.expr(f"place * {shards} div {max(totals['rows'], 1)}")
    else:
        number = F.least(F.expr(f"(2 * before + w) * {shards} div {2 * max(totals['w'] or 0, 1)}"), F.lit(shards - 1))
    cut = numbered.withColumn("shard", number.cast("int"))
    starts = cut.groupBy(F.col("shard").alias("s")).agg(F.min("place").alias("start"))
    return cut.join(F.broadcast(starts), F.col("shard") == F.col("s")).select(
        "row.*", "curve", "shard", (F.col("place") - F.col("start")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet files in the order of the curve, each inside one shard's folder."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(written: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row per file: ``file``, ``n_rows``, and ``low_<column>``, ``high_<column>`` of each dimension."""
    bounds = [f(f"`{c}`").alias(f"{name}_{c}") for c in dimensions for name, f in (("low", F.min), ("high", F.max))]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in dimensions]
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *bounds, *nulls)


def files_for(files: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The files of a manifest that may hold rows with ``low <= column <= high`` for every given column."""
    for column, (low, high) in ranges.items():
        files = files.where((F.col(f"`low_{column}`") <= F.lit(high)) & (F.col(f"`high_{column}`") >= F.lit(low)))
    return files


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(id, metadata, size, text_crc32): bytes of the text plus 1 and its checksum; no text is carried on."""
    source = slim(docs, id=doc_id, text=text, **{f"m_{c}": c for c in metadata})
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return source.select(
        F.col("id").alias("doc_id"), *[f"m_{c}" for c in metadata],
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )


def shard_table(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Shard and slot of each document, by language, source and size."""
    narrow = stored(measured(docs), "measured")
    placed = shard(narrow, ["m_lang", "m_source", "size"], shards=shards, ties=["text_crc32", "doc_id"], bits=bits)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
