"""Document fingerprints: one-permutation MinHash, optimal densification, packed low bits.

Every 5-word shingle is hashed once; the high bits of the hash choose a bin, the smallest
hash of a bin is its minimum. An empty bin copies the bin that its own random probe
sequence meets first (optimal densification), so bins agree with probability equal to the
similarity. Only the low ``bits`` of each minimum are kept, and the share of bins that
agree by chance is taken out of the estimate.

Defined cases: null and empty texts have the fingerprint "" (alike to each other only);
a text under five words is one shingle; words are runs without white space, A-Z folded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from auditweave.llm.common import batches_of, rows_of, slim, stored
from auditweave.llm.words import Reader, mix

BINS, BITS, WORDS = 512, 4, 5


class Fingerprinter:
    """Fingerprints of single texts; ``bins`` is a power of two, ``bits`` divides 8."""

    def __init__(self, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> None:
        self.bins, self.bits, self.k = bins, bits, words
        self.reader = Reader()
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.first_probes = self.probes(np.arange(bins), 0, 32)

    def probes(self, empty: np.ndarray, start: int, n: int) -> np.ndarray:
        attempt = np.arange(start, start + n, dtype=np.uint64)
        drawn = mix(empty.astype(np.uint64)[:, None] * np.uint64(1 << 32) + attempt[None, :] + np.uint64(1))
        return (drawn % np.uint64(self.bins)).astype(np.int64)

    def of(self, text: str) -> bytes:
        words = self.reader.words(text.encode("utf-8", "surrogatepass"))[2]
        hashes = np.sort(self.reader.shingles(words, self.k))
        if not len(hashes):
            return b""
        bins = (hashes >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        filled = np.zeros(self.bins, dtype=bool)
        filled[bins[first]] = True
        kept = np.zeros(self.bins, dtype=np.uint8)
        kept[bins[first]] = (hashes[first] & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        empty, start = np.flatnonzero(~filled), 0
        while len(empty):
            tried = self.first_probes[empty] if not start else self.probes(empty, start, 256)
            start += tried.shape[1]
            hit = filled[tried]
            found = hit.any(axis=1)
            kept[empty[found]] = kept[tried[found, hit[found].argmax(axis=1)]]
            empty = empty[~found]
        return self.pack(kept)

    def pack(self, kept: np.ndarray) -> bytes:
        each = 8 // self.bits
        places = np.arange(each, dtype=np.uint8) * np.uint8(self.bits)
        return (kept.reshape(-1, each) << places).sum(axis=1, dtype=np.uint8).tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        places = np.arange(8 // self.bits, dtype=np.uint8) * np.uint8(self.bits)
        return (np.frombuffer(packed, dtype=np.uint8)[:, None] >> places) & np.uint8((1 << self.bits) - 1)

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated similarity of the shingle sets, 0 to 1."""
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        chance = 1.0 / (1 << self.bits)
        agree = float((self.unpack(a) == self.unpack(b)).mean())
        return min(1.0, max(0.0, (agree - chance) / (1.0 - chance)))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> Column:
    """Hex fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        maker = Fingerprinter(bins, bits, words)
        for part in parts:
            yield part.map(lambda t: maker.of(t or "").hex())

    return run(text)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Bias-corrected similarity of two hex fingerprints."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        maker = Fingerprinter(bins, bits)
        for left, right in parts:
            yield pd.Series(
                [maker.likeness(bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(left, right)], dtype="float64"
            )

    return run(a, b)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_DONE, _FIRST, _LAST = 0, 1, 2
_PASS = pa.schema([
    ("role", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])
_PASS_DDL = (
    "role int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, text string"
)


def _compared(maker: Fingerprinter, part: int, doc_id, text: str, own: bytes, other: str, other_print: bytes) -> tuple:
    changed = edited(text, other)
    changed_print = maker.of(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        _DONE, part, doc_id, len(text), digest, own, changed_print,
        maker.likeness(own, changed_print), maker.likeness(own, other_print), None,
    )


def _weight(row: tuple) -> int:
    return 1_000 + len(row[-1] or "")


def neighbour_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS
) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document (descending id).

    One range shuffle by id brings each text to its neighbour: a task streams its range in
    ascending order and holds one earlier text. The first document of a range waits for the
    last of the range before; there are two such rows per partition, joined afterwards.
    Rows of equal id are ordered by text, rows without id come before all others.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, words)
        part = TaskContext.get().partitionId()

        def rows():
            before = None
            for key, body in rows_of(batches, ["doc_id", "text"]):
                body = body or ""
                own = maker.of(body)
                if before is None:
                    yield _FIRST, part, key, len(body), None, None, None, None, None, body
                else:
                    yield _compared(maker, part, key, body, own, *before)
                before = body, own
            if before:
                yield _LAST, part, None, None, None, None, None, None, None, before[0]

        yield from batches_of(rows(), _PASS, _weight)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, words)

        def rows():
            for part, key, body, other in rows_of(batches, ["part", "doc_id", "text", "other"]):
                yield _compared(maker, part, key, body, maker.of(body), other, maker.of(other))

        yield from batches_of(rows(), _PASS, _weight)

    ranged = slim(docs, doc_id=doc_id, text=text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    seen = stored(ranged.mapInArrow(stream, _PASS_DDL), "fingerprints")
    last = seen.where(F.col("role") == _LAST)
    # two numbers per partition: the part before each part, the greatest before the first
    order = Window.orderBy("part")
    chain = last.select(
        "part",
        F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("source"),
    )
    ends = last.select(F.col("part").alias("source"), F.col("text").alias("other"))
    waiting = (
        seen.where(F.col("role") == _FIRST).select("part", "doc_id", "text").join(chain, "part").join(ends, "source")
    )
    rows = seen.where(F.col("role") == _DONE).unionByName(waiting.mapInArrow(finish, _PASS_DDL))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
