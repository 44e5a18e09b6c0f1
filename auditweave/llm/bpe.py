"""BPE encoding and decoding by a priority queue of merge ranks over a linked symbol list.

Reads a tokenizer file in the JSON format of the tokenizers library with a BPE model,
normalizers NFC, white-space replacement and lower case, and a split by pattern. The file's
text travels with the tasks (its size is that of the vocabulary).

Defined cases: null and empty texts have no ids and decode to "". Special tokens written
out in a text become their ids, as in the library's default. A column of ``df`` with the name
of an output is replaced by it (names are compared as Spark does, without case).
"""

from __future__ import annotations

import heapq
import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from auditweave.llm.common import BATCH_BYTES, free_name, kept_beside, kept_in_worker

_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Entries that a task remembers, at about 250 bytes: chunks, and the words of mixed chunks.
CHUNK_ENTRIES, WORD_ENTRIES = 230_000, 70_000
_PLACE_BITS = 32  # of a queue entry; the rank is above
_PLACE = (1 << _PLACE_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.compose, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _BLANKS))
        self.blank = regex.compile(f"[{_BLANKS}]+")
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        # the id of each byte inside a word, and at its end
        self.inner = [self.vocab.get(c) for c in byte_symbols()]
        self.last = [self.vocab.get(c + self.suffix) for c in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left], self.vocab[right]] = (rank << _PLACE_BITS, self.vocab[left + right])
        size = max([*self.vocab.values(), *self.special.values()], default=-1) + 1
        self.strings = np.full(size, "", dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # plain letters are one pre-token, so such a chunk is a word and needs no search
        self.letters = self.pattern.findall(string.ascii_letters) == [string.ascii_letters]

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: always merge the pair of lowest rank, leftmost first.

        The queue holds rank and position as one number; an entry that is no longer the one
        of its position is stale and skipped.
        """
        data = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        n, ranked = len(ids), self.merges.get
        pairs = list(map(ranked, zip(ids, ids[1:])))
        queue = [found[0] | at for at, found in enumerate(pairs) if found]
        if not queue:
            return ids
        if len(queue) == 1:
            at = queue[0] & _PLACE
            ids[at : at + 2] = [pairs[at][1]]
            if n == 2 or not (at and ranked((ids[at - 1], ids[at])) or at < n - 2 and ranked((ids[at], ids[at + 1]))):
                return ids
            return self._merged(ids)
        return self._run(ids, pairs, queue)

    def _merged(self, ids: list[int]) -> list[int]:
        pairs = list(map(self.merges.get, zip(ids, ids[1:])))
        return self._run(ids, pairs, [found[0] | at for at, found in enumerate(pairs) if found])

    def _run(self, ids: list[int], pairs: list, queue: list[int]) -> list[int]:
        """Merge until the queue is empty; ``pairs`` has the rank and result of each position's pair."""
        n, ranked, push, pop = len(ids), self.merges.get, heapq.heappush, heapq.heappop
        pairs.append(None)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            at = entry & _PLACE
            found = pairs[at]
            if not found or found[0] != entry - at:
                continue
            right = after[at]
            ids[at] = merged = found[1]
            ids[right] = -1
            pairs[right] = None
            after[at] = following = after[right]
            if following >= 0:
                before[following] = at
                pairs[at] = found = ranked((merged, ids[following]))
                if found:
                    push(queue, found[0] | at)
            else:
                pairs[at] = None
            previous = before[at]
            if previous >= 0:
                pairs[previous] = found = ranked((ids[previous], merged))
                if found:
                    push(queue, found[0] | previous)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian int32, remembered while there is room."""
        if self.letters and word.isascii() and word.isalpha():
            return self.chunks.get(word) or self.remembered(self.chunks, CHUNK_ENTRIES, word)
        return self.remembered(self.words, WORD_ENTRIES, word)

    def remembered(self, cache: dict[str, bytes], entries: int, word: str) -> bytes:
        found = np.array(self.merge(word), dtype="<i4").tobytes()
        if len(cache) < entries and len(word) < 64:
            cache[word] = found
        return found

    def chunk(self, piece: str) -> bytes:
        """Ids of a stretch without white space, which no pre-token crosses."""
        if self.letters and piece.isascii() and piece.isalpha():
            return self.remembered(self.chunks, CHUNK_ENTRIES, piece)
        get, word = self.words.get, self.word
        found = b"".join([get(w) or word(w) for w in self.pattern.findall(piece)])
        if len(self.chunks) < CHUNK_ENTRIES and len(piece) < 64:
            self.chunks[piece] = found
        return found

    def plain(self, text: str) -> bytes:
        if self.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        pieces = self.blank.split(text) if odd else text.split()
        get, chunk = self.chunks.get, self.chunk
        return b"".join([get(p) or chunk(p) for p in pieces if p])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32."""
        if not self.special or not self.marks.search(text):
            return self.plain(text)
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += [self.plain(text[at : mark.start()]), np.array([self.special[mark[0]]], dtype="<i4").tobytes()]
            at = mark.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings of the ids; without a decoder in the file a space separates them."""
        return " ".join(self.strings[ids].tolist())


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode(
    df: DataFrame, path: str, text: str = "text", output: str = "ids", decoded: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Add the ids of each whole text, and in ``decoded``, if named, what they decode to.

    ``keep`` names the columns to carry (default all). Decoding in the same pass needs no
    second Python worker beside the one that encodes.
    """
    source = _source(path)
    outputs = [output, *([decoded] if decoded else [])]
    kept = kept_beside(df.columns if keep is None else keep, *outputs)
    names = [*kept, *outputs]
    body = free_name(names, "__text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    added = [F.array(F.lit(0)).alias(output), *([F.lit("").alias(decoded)] if decoded else [])]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(f"bpe_{zlib.crc32(source.encode())}", lambda: WordBpe(source))
        for whole in batches:
            for batch in _pieces(whole):
                found = [bpe.encode(t or "") for t in batch.column(len(kept)).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                columns = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)]
                if decoded:
                    columns.append(pa.array([bpe.decode(np.frombuffer(f, dtype="<i4")) for f in found], type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", output: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add the text that the ids of each row stand for; null ids give an empty text."""
    source = _source(path)
    kept = kept_beside(df.columns if keep is None else keep, output)
    body = free_name([*kept, output], "__ids")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").cast("array<int>").alias(body))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(output)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(f"bpe_{zlib.crc32(source.encode())}", lambda: WordBpe(source))
        for whole in batches:
            for batch in _pieces(whole):
                lists = batch.column(len(kept))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *[n or 0 for n in lists.value_lengths().to_pylist()]])
                texts = [bpe.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                columns = [*batch.columns[: len(kept)], pa.array(texts, type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, output])

    return rows.mapInArrow(run, schema)
