"""Token-id files: ORC stripes with run-length coded ids, row indexes and Bloom filters.

Documents are dealt out by ranges of ``doc_id`` and written in ascending order, so a file
holds one range, a stripe or row group can be skipped by its statistics, and the Bloom
filter answers point lookups. Stripes are read in parallel. Each row carries its number of
ids and that of those before it within its file's range; the offset of a range is the sum of those before.

Defined cases: null and empty texts have the end id alone; rows without ``doc_id`` come
first; rows of equal id are ordered by text. Special tokens written out in a text become
their ids, as in the tokenizers library's default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditweave.llm.common import BATCH_BYTES, kept_in_worker, slim

STRIPE_BYTES = 64 << 20
ROW_GROUP = 10_000
CACHE_ENTRIES = 800_000  # of a Python worker, at about 250 bytes
_SPACE = "\u0120"  # how byte-level vocabularies write the space
_MARKS = ".,;:!?%$"  # marks that end words
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"  # letters in every version of the character tables
_SCHEMA = "doc_id long, part int, before long, n int, ids array<int>"


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and where each begins and the last ends."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
    return np.frombuffer(b"".join(pieces), dtype="<i4"), np.concatenate([[0], np.cumsum(sizes)])


def _gathered(known: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces with these numbers one after the other, and where each begins and the last ends."""
    counts = np.diff(starts)[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return known[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])], ends


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct word of a task once.

    A byte-level pre-token never reaches past the boundary between a character and a
    single space after it, so a text may be cut there: every chunk but the first begins
    with its space. Where a chunk is words with marks, on one line or two, those are
    pre-tokens of their own (tried on the tokenizer first). What is left is encoded by the
    library, many at once, and remembered.
    """

    def __init__(self, source: str, cache_entries: int = CACHE_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocab.items() if token.startswith(_SPACE)]] = True
        self.cache_entries = cache_entries
        self.loose = re.compile(r"\s ").search
        self.blanks = [f"{c} " for c in map(chr, range(128)) if c.isspace()]
        self.cut = re.compile(r"(?<=\S) ")
        self.parts = (
            rf"\A(?P<word>{_LETTERS})(?P<marks>[{_MARKS}]*)(?:(?P<line>\n)(?P<next>{_LETTERS})(?P<after>[{_MARKS}]*))?\z"
        )
        parts = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f" ab{_MARKS}\ncd")]
        self.units = parts == [f"{_SPACE}ab", _MARKS, "\u010a", "cd"]
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}  # ids of chunks, named without their space
        self.bare: dict[str, bytes] = {"": b""}  # ids of marks, and of words that begin a line

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<i4").tobytes() for e in found]

    def spaced(self, chunks: list[str]) -> None:
        """Encode chunks side by side; a token that begins with the space begins a chunk."""
        for at in range(0, len(chunks), 256):
            new = chunks[at : at + 256]
            ids = np.frombuffer(self.library([" " + " ".join(new)])[0], dtype="<i4")
            data, starts = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(starts) != len(new):
                raise ValueError("the vocabulary lets a token reach past a space")
            self.cache.update((c, data[a:b]) for c, a, b in zip(new, starts, [*starts[1:], len(data)]))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks, named without their space; new ones are remembered."""
        found = list(map(self.cache.get, words))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        several = [i for i in unknown if " " in words[i] or not words[i]]
        self.cache.update(zip([words[i] for i in several], self.library([f" {words[i]}" for i in several])))
        self.spaced([words[i] for i in unknown if words[i] and " " not in words[i]])
        for i in unknown:
            found[i] = self.cache[words[i]]
        return found

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and where each begins.

        Words are told from their marks inside Arrow; Python sees each word and each kind of marks once.
        """
        parts = chunks.slice(0, 0)
        marked = np.zeros(0, dtype=np.int64)
        words = chunks
        if self.units:
            split = pc.extract_regex(chunks, self.parts)
            fields = [pc.struct_field(split, i) for i in range(5)]
            words = pc.coalesce(fields[0], chunks)
            marked = np.flatnonzero(pc.not_equal(words, chunks).to_numpy(zero_copy_only=False))
            parts = pa.concat_arrays([f.take(pa.array(marked)) for f in fields[1:]])
        words, parts = words.dictionary_encode(), parts.dictionary_encode()
        found = self.words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        others = [name for name in names if name not in self.bare]
        self.bare.update(zip(others, self.library(others)))
        # five places a chunk: the word, then marks, line end, word and marks, or the empty last piece
        places = np.full((len(chunks), 5), len(found) + len(names), dtype=np.int32)
        places[:, 0] = words.indices.to_numpy()
        places[marked, 1:] = parts.indices.to_numpy().reshape(4, -1).T + len(found)
        found += [*map(self.bare.__getitem__, names), b""]
        ids, ends = _gathered(*_joined(found), places.ravel())
        return ids, ends[::5]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian int32."""
        if len(self.cache) + len(self.bare) > self.cache_entries:
            self.forget()
        plain, others, pieces, whole = [], [], [], []
        for at, text in enumerate(texts):
            if any(token in text for token in self.special):
                whole.append(at)
            elif text[:1].isspace() or (any(b in text for b in self.blanks) if text.isascii() else self.loose(text)):
                others.append(at)
                pieces.append(self.cut.split(text))
            else:
                plain.append(at)
        # words become numbers inside Arrow, so that Python sees each distinct word of a batch once
        lists = pa.concat_arrays([
            pc.split_pattern(pa.array([texts[at] for at in plain], type=pa.string()), " "),
            pa.array(pieces, type=pa.list_(pa.string())),
        ])
        bounds = lists.offsets.to_numpy()
        first = np.zeros(bounds[-1], dtype=bool)
        first[bounds[:-1]] = True
        words = lists.flatten()
        heads = self.library(words.filter(pa.array(first)).to_pylist())
        numbered = words.filter(pa.array(~first)).dictionary_encode()
        known, starts = self.chunks(numbered.dictionary)
        ids, ends = _gathered(known, starts, numbered.indices.to_numpy())
        cuts = ends[bounds - np.arange(len(bounds))].tolist()
        out = [b""] * len(texts)
        for at, head, a, b in zip([*plain, *others], heads, cuts, cuts[1:]):
            out[at] = head + ids[a:b].tobytes()
        for at, coded in zip(whole, self.library([texts[at] for at in whole])):
            out[at] = coded
        return out


def write(
    docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None
) -> None:
    """Write the ids of every whole text to ``path`` in ascending ``doc_id`` order."""
    with open(vocabulary, encoding="utf-8") as file:
        source = file.read()
    tail = b"" if end_id is None else np.array([end_id], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(f"chunks_{zlib.crc32(source.encode())}", lambda: ChunkEncoder(source))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                found = [ids + tail for ids in encoder.encode([t or "" for t in rows.column(1).to_pylist()])]
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, type=pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                )
                parts = pa.array(np.full(len(found), part, dtype=np.int32))
                starts = pa.array(ends[:-1].astype(np.int64) + before)
                counts = pa.array(np.diff(ends).astype(np.int32))
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), parts, starts, counts, ids], names=["doc_id", "part", "before", "n", "ids"]
                )

    ranged = slim(docs, doc_id=doc_id, text=text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ranged.mapInArrow(run, _SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before) and ``ids`` from the files.

    A filter on ``doc_id`` reaches the stripes' statistics and Bloom filters. Offsets need
    one number per range of the writer.
    """
    files = spark.read.schema(_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes that cannot hold them are skipped."""
    files = spark.read.schema(_SCHEMA).orc(path)
    return files.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda found: zlib.crc32(np.asarray(found, dtype="<u4").tobytes()))

    return run(ids)
