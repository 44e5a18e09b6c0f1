"""Suffix-array dedup: sparse suffixes at minimiser positions, sorted, compared, extended.

1. Of every 25 consecutive positions the one whose next 26 words hash lowest is kept, so
   any 50 words that two texts share hold a common kept position.
2. Kept suffixes are sorted by their first 26 words, then by document and position (a range
   sort, so a passage in a third of all documents spreads over many tasks), and neighbours
   are compared.
3. Where two suffixes begin alike, the later is linked to the earlier. Links on one diagonal
   merge to stretches; both texts are read again around a stretch, it is checked and
   extended word by word to the left and to the right.
4. Where three or more begin alike (a crowd), pairs would grow with the square. All stretches
   of 50 words around each of them, which reach as far as a match could be extended, are
   compared with the first document that has the same; repeated ones that follow each other
   and go on in the same source are one passage. That is linear in the crowd.

A result row says that words [start_word, end_word) of a document repeat those of an
earlier one (smaller ``doc_id``); the earliest copy is not reported. A text that equals an
earlier document's is one row over all its words. No row lies inside another of its document.

Words are runs without white space, compared exactly. Defined cases: texts under
``min_words`` words, null texts, rows without ``doc_id`` and rows whose id stands for
several texts take no part and stay as they are; repeated rows are one document. Repeats
inside a document are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditweave.llm.common import batches_of, probably_listed, rows_of, slim, stored, without
from auditweave.llm.words import Reader, mix

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_SECOND = np.uint64(0x9E3779B97F4A7C15)  # makes another hash of the same words
# A stretch of words is common if more rows than this, and than this share of all, have it.
COMMON_ROWS, COMMON_SHARE = 1_000, 50_000


def _widths(min_words: int) -> tuple[int, int]:
    """Words that select a suffix, and positions of which one is kept."""
    gram = min_words // 2 + 1
    return gram, min_words - gram + 1


def kept_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window of consecutive positions."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def _identities(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, n_words, first): id of the first document with the same text."""
    ids = stored(
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("key"), F.md5("text").alias("check"), F.regexp_count("text", F.lit(_WORD)).alias("n_words"))
        .distinct(),
        "identities",
    )
    several = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    single = ids.join(several, "doc_id", "left_anti").where(F.col("n_words") >= min_words)
    first = single.groupBy("key", "check").agg(F.min("doc_id").alias("first"))
    return stored(single.join(first, ["key", "check"]).select("doc_id", "n_words", "first"), "firsts")


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(beginning, doc, pos): hash of the first words of each kept suffix."""
    gram, window = _widths(min_words)
    names = ["beginning", "doc", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

        for doc, text in rows_of(batches, ["doc_id", "text"]):
            words = reader.words((text or "").encode("utf-8", "surrogatepass"))[2]
            hashes = reader.stretches(words, gram)
            at = kept_positions(hashes, window)
            if not len(at):
                continue
            held.append((hashes[at].view(np.int64), np.full(len(at), doc, dtype=np.int64), at.astype(np.int32)))
            size += len(at)
            if size > 50_000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return docs.mapInArrow(run, "beginning long, doc long, pos int")


class _Sorted:
    """Sorted suffixes of one partition, told apart into pairs and crowds of equal beginning.

    ``held`` are the rows of the last beginning while they are fewer than three. The first
    and the last beginning of a partition may go on in others, so they count as crowds.
    """

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.last: int | None = None  # the last beginning, if it is a crowd already
        self.begun = False

    def of(self, *columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(doc, pos, to_doc, to_pos) of pairs, and (doc, pos) of crowds."""
        if self.held:
            columns = tuple(np.concatenate(c) for c in zip(self.held, columns))
        begin, doc, pos = columns
        starts = np.flatnonzero(np.append(True, begin[1:] != begin[:-1]))
        ends = np.append(starts[1:], len(begin))
        sizes = ends - starts
        open_ = np.zeros(len(starts), dtype=bool)
        open_[0] = not self.begun or begin[0] == self.last
        crowd = (sizes >= 3) | open_
        open_[-1] = True
        # a beginning of one document alone repeats nothing
        alone = ~open_ & (doc[starts] == doc[ends - 1])
        self.begun = True
        self.last = int(begin[-1]) if crowd[-1] else None
        self.held = [] if crowd[-1] else [c[starts[-1] :] for c in columns]
        first = starts[(sizes == 2) & ~crowd & ~alone & ~open_]
        rows = np.repeat(crowd & ~alone, sizes)
        return [doc[first + 1], pos[first + 1], doc[first], pos[first]], [doc[rows], pos[rows]]


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """Compare sorted suffixes: links of pairs, and rows of crowds, which have no ``to_doc``."""
    names = ["doc", "pos", "to_doc", "to_pos"]
    order = ["beginning", "doc", "pos"]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Sorted()

        def crowded(doc, pos):
            n = len(doc)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)

        for part in batches:
            if part.num_rows:
                pairs, crowds = seen.of(*[c.to_numpy(zero_copy_only=False) for c in part.columns])
                if len(pairs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=names)
                if len(crowds[0]):
                    yield crowded(*crowds)
        if seen.held:
            yield crowded(*seen.held[1:])

    return ranged.mapInArrow(run, "doc long, pos int, to_doc long, to_pos int")


def _windows(docs: DataFrame, crowd: DataFrame, min_words: int) -> DataFrame:
    """(around, check, doc, pos): every stretch of ``min_words`` words around the crowds' suffixes."""
    gram, _ = _widths(min_words)
    asked = stored(crowd.groupBy("doc").agg(F.collect_list("pos").alias("asked")), "crowded")
    texts = probably_listed(docs, F.col("doc_id"), asked, "doc").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)
        names = ["around", "check", "doc", "pos"]
        for doc, text, places in rows_of(batches, ["doc_id", "text", "asked"]):
            words = reader.words((text or "").encode("utf-8", "surrogatepass"))[2]
            hashes = reader.stretches(words, min_words)
            near = np.array(places)[:, None] - np.arange(min_words - gram + 1)
            at = np.unique(near[(near >= 0) & (near < len(hashes))])
            if len(at):
                check = reader.stretches(mix(words ^ _SECOND), min_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[at].view(np.int64)), pa.array(check[at].view(np.int64)),
                        pa.array(np.full(len(at), doc, dtype=np.int64)), pa.array(at.astype(np.int32)),
                    ],
                    names=names,
                )

    found = texts.join(asked, texts["doc_id"] == asked["doc"]).select("doc_id", "text", "asked")
    return found.mapInArrow(run, "around long, check long, doc long, pos int")


def _crowd_passages(windows: DataFrame, min_words: int) -> DataFrame:
    """Passages from stored windows: each repeated one goes to the first document that has it.

    The first places of common windows, at most ``COMMON_SHARE`` of them, are broadcast;
    those of the others are joined by a shuffle in which no key has many rows.
    """
    key = ["around", "check"]
    common = max(COMMON_ROWS, windows.count() // COMMON_SHARE)
    places = windows.groupBy(*key).agg(
        F.min(F.struct("doc", "pos")).alias("least"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")
    )
    repeated = stored(
        places.where(F.col("last") > F.col("least.doc"))
        .select(*key, F.col("least.doc").alias("to_doc"), F.col("least.pos").alias("to_pos"), "n"),
        "repeated",
    )
    often = F.broadcast(repeated.where(F.col("n") > common).drop("n"))
    others = windows.join(often.select(*key), key, "left_anti").join(repeated.where(F.col("n") <= common).drop("n"), key)
    found = (
        windows.join(often, key).unionByName(others).where(F.col("doc") > F.col("to_doc"))
        .select("doc", "pos", "to_doc", (F.col("pos") - F.col("to_pos")).alias("shift"))
    )
    order = Window.partitionBy("doc").orderBy("pos")
    follows = (
        (F.lag("pos").over(order) == F.col("pos") - 1)
        & (F.lag("to_doc").over(order) == F.col("to_doc"))
        & (F.lag("shift").over(order) == F.col("shift"))
    )
    numbered = found.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = numbered.groupBy("doc", "run").agg(
        F.min("pos").cast("long").alias("start_word"), (F.max("pos") + min_words).cast("long").alias("end_word"),
        F.min("to_doc").alias("source_doc_id"), F.min("shift").alias("shift"),
    )
    return runs.select(
        F.col("doc").alias("doc_id"), "start_word", "end_word", "source_doc_id",
        (F.col("start_word") - F.col("shift")).alias("source_word"),
    )


def _outermost(passages: DataFrame) -> DataFrame:
    """Rows that lie in no other row of their document; of equal stretches the earliest source."""
    order = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), "source_doc_id", "source_word")
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return passages.withColumn("__reached", reached).where(
        F.col("__reached").isNull() | (F.col("end_word") > F.col("__reached"))
    ).drop("__reached")


def _stretches(links: DataFrame, gram: int) -> DataFrame:
    """Runs of overlapping links on one diagonal: words [start, end) of ``doc``."""
    on = ["doc", "to_doc", "shift"]
    order = Window.partitionBy(*on).orderBy("pos")
    shifted = links.withColumn("shift", F.col("pos") - F.col("to_pos"))
    breaks = shifted.withColumn("new", (F.col("pos") - F.lag("pos", 1, -1_000_000).over(order) > gram).cast("int"))
    numbered = breaks.withColumn("run", F.sum("new").over(order))
    return numbered.groupBy(*on, "run").agg(F.min("pos").alias("start"), (F.max("pos") + gram).alias("end")).drop("run")


def _contexts(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """For (doc, start, end): hash of the words between, and the words on both sides."""
    schema = pa.schema([
        ("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("core", pa.int64()),
        ("left", pa.binary()), ("right", pa.binary()),
    ])
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("asked"))
    texts = probably_listed(docs, F.col("doc_id"), wanted, "doc").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)

        def rows():
            for doc, text, asked in rows_of(batches, ["doc_id", "text", "asked"]):
                words = reader.words((text or "").encode("utf-8", "surrogatepass"))[2]
                for piece in asked:
                    a, b = piece["start"], piece["end"]
                    core = int(reader.stretches(words[a:b], b - a).view(np.int64)[0]) if b <= len(words) else 0
                    yield doc, a, b, core, words[max(0, a - reach) : a][::-1].tobytes(), words[b : b + reach].tobytes()

        yield from batches_of(rows(), schema, lambda row: len(row[4]) + len(row[5]) + 64)

    return texts.join(asked, texts["doc_id"] == asked["doc"]).select("doc_id", "text", "asked").mapInArrow(
        run, "doc long, start int, end int, core long, left binary, right binary"
    )


def _extended(stretches: DataFrame, contexts: DataFrame, min_words: int) -> DataFrame:
    """Check stretches and extend them; those that reach ``min_words`` words."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()),
        ("source_doc_id", pa.int64()), ("source_word", pa.int64()),
    ])
    own = contexts.toDF("doc", "start", "end", "core", "left", "right")
    other = contexts.toDF("to_doc", "to_start", "to_end", "to_core", "to_left", "to_right")
    both = (
        stretches.withColumn("to_start", F.col("start") - F.col("shift")).withColumn("to_end", F.col("end") - F.col("shift"))
        .join(other, ["to_doc", "to_start", "to_end"]).join(own, ["doc", "start", "end"])
        .where(F.col("core") == F.col("to_core"))
    )

    def agree(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // 8
        differ = np.frombuffer(a, dtype=np.uint64)[:n] != np.frombuffer(b, dtype=np.uint64)[:n]
        return int(differ.argmax()) if differ.any() else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "end", "to_doc", "to_start", "left", "right", "to_left", "to_right"]

        def rows():
            for doc, start, end, to_doc, to_start, left, right, to_left, to_right in rows_of(batches, names):
                before, after = agree(left, to_left), agree(right, to_right)
                if end + after - start + before >= min_words:
                    yield doc, start - before, end + after, to_doc, to_start - before

        yield from batches_of(rows(), schema, lambda row: 40)

    return both.mapInArrow(
        run, "doc_id long, start_word long, end_word long, source_doc_id long, source_word long"
    )


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, start_word, end_word, source_doc_id, source_word) of repeated passages.

    Passages of a document may overlap, as they can come from different sources.
    """
    gram, _ = _widths(min_words)
    source = slim(docs, doc_id=doc_id, text=text)
    ids = _identities(source, min_words)
    copies = ids.where("doc_id > first")
    leading = ids.where("doc_id = first").select("doc_id")
    # copies, small texts and ambiguous ids are left out by id before anything is hashed
    others = source.select("doc_id").where(F.col("doc_id").isNotNull()).join(leading, "doc_id", "left_anti").distinct()
    unique = without(source.where(F.col("doc_id").isNotNull()), F.col("doc_id"), stored(others, "others"), "doc_id")
    seen = stored(_neighbours(stored(_suffixes(unique, min_words), "suffixes")), "neighbours")
    links = seen.where(F.col("to_doc").isNotNull())
    windows = stored(_windows(unique, seen.where(F.col("to_doc").isNull()), min_words), "windows")
    stretches = stored(_stretches(links, gram), "stretches")
    wanted = stored(
        stretches.select("doc", "start", "end")
        .union(stretches.select("to_doc", F.col("start") - F.col("shift"), F.col("end") - F.col("shift")))
        .distinct(),
        "wanted",
    )
    contexts = stored(_contexts(unique, wanted, min_words + 1), "contexts")
    found = _outermost(_extended(stretches, contexts, min_words).union(_crowd_passages(windows, min_words)))
    whole = copies.select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("end_word"),
        F.col("first").alias("source_doc_id"), F.lit(0).cast("long").alias("source_word"),
    )
    return found.union(whole)


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """Cut the passages out of the texts; ``n_chars`` names a length column to keep true.

    A passage goes with the white space after it. Documents without passages are not moved.
    """
    columns = docs.columns
    spans = stored(
        passages.groupBy(F.col("doc_id").alias("__doc")).agg(
            F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("__spans")
        ),
        "spans",
    )
    key = F.col(f"`{doc_id}`")
    touched = probably_listed(docs, key, spans, "__doc").join(spans, key == F.col("__doc")).drop("__doc")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)

        def cut(body: str | None, spans: list) -> str | None:
            data = (body or "").encode("utf-8", "surrogatepass")
            starts, _ = reader.bounds(data)
            ends = [*starts.tolist(), len(data)]
            out, at = [], 0
            for span in spans:
                a, b = ends[min(span["start_word"], len(starts))], ends[min(span["end_word"], len(starts))]
                if b > at:
                    out.append(data[at : max(a, at)])
                    at = b
            return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            spans = batch.column(names.index("__spans")).to_pylist()
            new = [cut(t, s) for t, s in zip(texts, spans)]
            arrays = [batch.column(names.index(c)) for c in columns]
            arrays[columns.index(text)] = pa.array(new, type=pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    changed = touched.mapInArrow(run, schema)
    if n_chars:
        changed = changed.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(schema[n_chars].dataType))
    return without(docs, key, spans, "__doc").unionByName(changed.select(*[f"`{c}`" for c in columns]))
