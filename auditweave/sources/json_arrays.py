"""Files that hold one JSON array each, read as many byte ranges.

Spark's text reader cuts a file into ranges at any byte and hands out *pieces* that end
with ``}``. Whether such a brace closes an element of the array depends on everything
before it, but only through two values: is the piece inside a string, and how deep are the
brackets. Both are prefix sums. Each range is summed up for either start (outside or inside
a string); a scan over these sums, one row per range, tells how a range really starts. Then
every range finds its own element ends, and what was cut by a range border is put together
from the ends of neighbouring ranges.

A backslash cannot stand before ``}`` in JSON, so no escape crosses two pieces. The bytes
are shuffled once, by range; elements inside a range are grouped without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_RANGE = ("file", "start")


def _brackets(text: Column) -> Column:
    """Opening minus closing brackets of a text without strings and closing braces."""
    size = F.length(text)
    opened = size - F.length(F.translate(text, "{[", ""))
    closed = size - F.length(F.translate(text, "]", ""))
    return opened - closed


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, file_size, start, seq, value, n_bytes, quotes, outside, inside): the file cut after each brace.

    ``quotes`` counts the quotation marks, ``outside`` and ``inside`` are the changes of the
    bracket depth for a piece that begins outside or inside a string, its brace not included.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    cut = read.withColumn("parts", parts)

    def every_other(rest: int) -> Column:
        return _brackets(F.array_join(F.filter("parts", lambda _, i: i % 2 == rest), ""))

    return cut.select(
        "file", "file_size", "start", "seq", "value", (F.octet_length("value") + 1).cast("long").alias("n_bytes"),
        (F.size("parts") - 1).cast("long").alias("quotes"),
        every_other(0).alias("outside"), every_other(1).alias("inside"),
    )


def _with_states(cut: DataFrame) -> DataFrame:
    """Adds what holds after a piece if its range starts outside (0) or inside (1) a string.

    ``in0``, ``in1``: is the next piece inside a string; ``deep0``, ``deep1``: bracket depth
    against the start of the range, closing braces included.
    """
    so_far = Window.partitionBy(*_RANGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = cut.withColumn("after", F.sum("quotes").over(so_far))
    before = F.col("after") - F.col("quotes")
    for start in (0, 1):
        inside = (before + start) % 2 == 1
        ends_inside = (F.col("after") + start) % 2 == 1
        change = F.when(inside, F.col("inside")).otherwise(F.col("outside")) - F.when(ends_inside, 0).otherwise(1)
        marked = marked.withColumn(f"in{start}", ends_inside).withColumn(f"deep{start}", F.sum(change).over(so_far))
    return marked


def _starts(states: DataFrame) -> DataFrame:
    """(file, start, begins_inside, depth, lacks): state at the beginning of every range of a file.

    ``lacks`` marks the last range of a file whose last piece has no brace behind it.
    """
    ranges = states.groupBy(*_RANGE).agg(
        F.max("file_size").alias("file_size"), F.sum("n_bytes").alias("n_bytes"), F.sum("quotes").alias("quotes"),
        F.max_by("deep0", "seq").alias("d0"), F.max_by("deep1", "seq").alias("d1"),
    )
    in_file = Window.partitionBy("file")
    earlier = in_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    placed = ranges.withColumn("begins_inside", inside).withColumn("d", F.when(F.col("begins_inside"), F.col("d1")).otherwise(F.col("d0")))
    # Every piece was counted with a brace; a byte order mark (3 bytes) is skipped by the reader.
    over = F.sum("n_bytes").over(in_file) - F.max("file_size").over(in_file)
    return placed.select(
        *_RANGE, "begins_inside",
        F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth"),
        ((F.col("start") == F.max("start").over(in_file)) & ~over.isin(0, -3)).alias("lacks"),
    )


def _fragments(states: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, start, no, text, closed): pieces of a range joined up to each end of an element."""
    placed = states.join(starts, list(_RANGE))
    in_range = Window.partitionBy(*_RANGE).orderBy("seq")
    inside = F.when(F.col("begins_inside"), F.col("in1")).otherwise(F.col("in0"))
    depth = F.col("depth") + F.when(F.col("begins_inside"), F.col("deep1")).otherwise(F.col("deep0"))
    bare = F.col("lacks") & F.lead("seq").over(in_range).isNull()
    ended = placed.select(
        *_RANGE, "seq", (~inside & (depth == 1) & ~bare).alias("ends"),
        F.when(bare, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value"),
    )
    before = F.coalesce(F.sum(F.col("ends").cast("long")).over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"])
    return (
        ended.withColumn("no", before)
        .groupBy(*_RANGE, "no")
        .agg(F.array_join(texts, "").alias("text"), F.max("ends").alias("closed"))
    )


def _joined(fragments: DataFrame) -> DataFrame:
    """(text): elements inside a range as they are, those across borders put together."""
    whole = fragments.where(F.col("closed") & (F.col("no") > 0)).select("text")
    edges = fragments.where(~F.col("closed") | (F.col("no") == 0))
    earlier = Window.partitionBy("file").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = edges.withColumn("element", F.coalesce(F.sum(F.col("closed").cast("long")).over(earlier), F.lit(0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "no", "text"))), lambda p: p["text"])
    return whole.unionByName(numbered.groupBy("file", "element").agg(F.array_join(texts, "").alias("text")).select("text"))


def read_json_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per element as JSON text in ``raw``; a file is as many tasks as it has ranges.

    A text between two ends of elements may hold several elements that are not objects; it
    is read as an array of its own. Ranges follow ``spark.sql.files.maxPartitionBytes``.
    Compressed files are one range. Text that is not JSON is handed on as it is.
    """
    states = _with_states(pieces(spark, path))
    texts = _joined(_fragments(states, _starts(states)))
    inner = F.regexp_replace(F.regexp_replace("text", r"^\uFEFF?\s*[\[,]", ""), r"\]\s*$", "")
    listed = F.when(F.trim(F.translate(inner, "\r\n\t", "   ")) != "", inner)
    items = F.expr("cast(try_parse_json(concat('[', inner, ']')) as array<variant>)")
    found = texts.select(listed.alias("inner")).where(F.col("inner").isNotNull()).select("inner", items.alias("items"))
    broken = F.when(F.col("items").isNull(), F.array("inner")).otherwise(F.transform("items", lambda v: F.to_json(v)))
    return found.select(F.explode(broken).alias("raw"))
