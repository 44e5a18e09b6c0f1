"""MinHash near-dedup by SetSketch: band the registers, estimate by likelihood, verify.

1. Every text becomes a sketch of its shingle set. Equal texts are one node from here on.
2. Runs of registers (bands) are buckets. In each bucket the smallest node is the pivot;
   pairs (pivot, member) whose likelihood estimate can reach the threshold are verified on
   the full sets, and verified links are contracted to components.
3. Buckets that still hold several components are compared completely: in blocks of
   bounded text size, one block pair per group, only links between components are emitted.

So every pair of texts that shares a bucket and is not already connected is verified; a
pair at the threshold shares no bucket with probability below 1e-8 if its registers are
independent. Those of a few shingles are not, so sets of up to ``FEW`` shingles also have
exact buckets: of n shingles that can differ in d, any d + 1 hold a common one, and the
d + 1 with the smallest hashes are the set's buckets. Such pairs are never missed. Nothing is capped: a
bucket of any size is cut into more blocks. Per bucket one row per member is shuffled,
never a row per pair.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle. Rows without ``doc_id`` are linked and
never become the id of a component (a component of only such rows has none and keeps all).
Rows that repeat an id are separate texts under that id. Texts are told apart by 128 bits of
hash: where two share the first 64, both get new keys from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.llm.common import batches_of, probably_listed, rows_of, slim, stored, without
from auditweave.llm.components import connected
from auditweave.llm.setsketch import REGISTERS, SetSketch
from auditweave.llm.words import Reader

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
BLOCK_CHARS = 1 << 20
MISSED = 1e-8
FEW = 20
_SIGMAS = 6.5
_EDGES = "a long, b long"
_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def text_key(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text)


def _told_apart(rows: DataFrame, clash: DataFrame, level: int) -> DataFrame:
    """Rows whose ``key`` is listed get another, from both of their hashes."""
    listed = clash.select("key", F.lit(True).alias("__clash"))
    other = F.when(F.col("__clash"), F.xxhash64(F.lit(level), "key", "check")).otherwise(F.col("key"))
    return rows.join(listed, "key", "left").withColumn("key", other).select(*rows.columns)


def band_rows(similarity: float, registers: int = REGISTERS) -> int:
    """Most registers per band with which a pair at the threshold is missed with at most ``MISSED``."""
    fits = [r for r in range(1, 33) if (1.0 - similarity**r) ** (registers // r) <= MISSED]
    return max(fits, default=1)


def exact_keys(shingles: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Smallest hashes of a sorted set; two sets at the threshold have one of them in common."""
    n = len(shingles)
    return shingles[: n - -(-numerator * n // denominator) + 1]


def sketches(docs: DataFrame, words: int, seed: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``doc_id``, ``key`` and ``check`` of the text, ``n_shingles``, ``registers`` (null if empty), ``exact`` (if few)."""
    rows = slim(docs, doc_id="doc_id", text="text").select(
        "doc_id", text_key(F.col("text"), seed).alias("key"), text_key(F.col("text"), seed + 1).alias("check"), "text"
    )
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.int64()), ("check", pa.int64()),
        ("n_shingles", pa.int64()), ("registers", pa.binary()),
        ("exact", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sketch = Reader(), SetSketch()
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [reader.shingle_set(t, words) for t in part.column(3).to_pylist()]
                found = sketch.of(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, found)], type=pa.binary()),
                        pa.array(
                            [exact_keys(s, numerator, denominator).view(np.int64) if 0 < len(s) <= FEW else None for s in sets],
                            type=pa.list_(pa.int64()),
                        ),
                    ],
                    schema=schema,
                )

    return rows.mapInArrow(run, "doc_id long, key long, check long, n_shingles long, registers binary, exact array<long>")


def buckets(signed: DataFrame, rows: int) -> DataFrame:
    """(bucket, key): one row for each band of each sketch and for each exact key."""
    bands = REGISTERS // rows
    piece = lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * rows) + 1, F.lit(2 * rows)))
    exact = F.transform(F.coalesce("exact", F.array().cast("array<long>")), lambda h: F.xxhash64(F.lit(-1), h))
    return signed.where(F.col("n_shingles") > 0).select(
        "key", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), piece), exact)).alias("bucket")
    )


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose joint likelihood estimate is not clearly below the threshold, or of few shingles."""
    margin = _SIGMAS * (similarity * (1.0 - similarity) / REGISTERS) ** 0.5
    a = nodes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    b = nodes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch()
        for batch in batches:
            if batch.num_rows:
                rows = batch.to_pydict()
                left = np.frombuffer(b"".join(rows["r_a"]), dtype=np.uint16).reshape(-1, sketch.m)
                right = np.frombuffer(b"".join(rows["r_b"]), dtype=np.uint16).reshape(-1, sketch.m)
                n_a, n_b = np.array(rows["n_a"], dtype=float), np.array(rows["n_b"], dtype=float)
                fits = (sketch.similarity(left, right, n_a, n_b) >= similarity - margin) | (np.maximum(n_a, n_b) <= FEW)
                yield batch.filter(pa.array(fits)).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, _EDGES)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs that are linked by their full shingle sets."""
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("t_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def linked():
            last, pivot = None, None
            for left, right, t_a, t_b in rows_of(batches, ["a", "b", "t_a", "t_b"]):
                if left != last:
                    last, pivot = left, reader.shingle_set(t_a, words)
                other = reader.shingle_set(t_b, words)
                common = len(np.intersect1d(pivot, other, assume_unique=True))
                if denominator * common >= numerator * (len(pivot) + len(other) - common):
                    yield left, right

        yield from batches_of(linked(), _EDGE_SCHEMA, lambda row: 16)

    # the pivot joins last, so that its pairs arrive together and its set is made once
    return pairs.join(b, "b").join(a, "a").mapInArrow(run, _EDGES)


def _between(rest: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int, block_chars: int) -> DataFrame:
    """Links between different components inside each bucket, all pairs compared in blocks."""
    sized = rest.join(texts.select("key", "n_chars"), "key")
    parts = sized.groupBy("bucket").agg(F.ceil(F.sum("n_chars") / block_chars).cast("long").alias("parts"))
    dealt = (
        sized.join(parts, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.greatest("parts", F.lit(1))))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)))
        .select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "label"
        )
    )
    groups = ["bucket", "i", "j"]
    placed = dealt.join(texts.select("key", "text"), "key").repartition(*groups).sortWithinPartitions(*groups, "own", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def compare(i, j, members):
            sets = [reader.shingle_set(m[3], words) for m in members]
            sizes = np.array([len(s) for s in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            labels = np.unique(np.array([m[2] for m in members]), return_inverse=True)[1]
            own = np.array([m[0] for m in members])
            mark = np.zeros(ids.max() + 1, dtype=bool)
            for x in range(len(members)):
                if i != j and own[x] != i:
                    break
                first = x + 1 if i == j else int(np.searchsorted(own, j))
                if first >= len(members):
                    break
                if (labels[first:] == labels[x]).all():
                    continue
                mine = ids[starts[x] : starts[x] + sizes[x]]
                mark[mine] = True
                common = np.add.reduceat(mark[ids[starts[first] :]], starts[first:] - starts[first], dtype=np.int64)
                mark[mine] = False
                union = sizes[x] + sizes[first:] - common
                hits = np.flatnonzero((denominator * common >= numerator * union) & (labels[first:] != labels[x])) + first
                for label in np.unique(labels[hits]):
                    yield members[x][1], members[hits[labels[hits] == label][0]][1]
                joined = np.isin(labels, labels[hits])
                labels[joined] = labels[x]

        def linked():
            group, members = None, []
            for bucket, i, j, own, key, label, text in rows_of(batches, [*groups, "own", "key", "label", "text"]):
                if (bucket, i, j) != group:
                    if len(members) > 1:
                        yield from compare(group[1], group[2], members)
                    group, members = (bucket, i, j), []
                members.append((own, key, label, text))
            if len(members) > 1:
                yield from compare(group[1], group[2], members)

        yield from batches_of(linked(), _EDGE_SCHEMA, lambda row: 16)

    return placed.mapInArrow(run, _EDGES)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    seed: int = 1,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Components of texts with ``denominator * |A & B| >= numerator * |A | B|``.

    One row per input row: ``doc_id``, ``check`` (hash of the text), ``n_shingles``,
    ``component_id`` (smallest id reachable) and ``kept``.
    """
    similarity = numerator / denominator
    source = slim(docs, doc_id=doc_id, text=text)
    signed = stored(sketches(source, words, seed, numerator, denominator), "sketches")
    clashes: list[DataFrame] = []
    while True:
        clash = signed.groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi")
        if clash.isEmpty():
            break
        # some texts in 10^10 share a 64-bit hash; the second hash makes their keys differ
        clashes.append(stored(clash.select("key"), "clashes"))
        signed = stored(_told_apart(signed, clashes[-1], len(clashes)), "sketches")

    rows = buckets(signed, band_rows(similarity))
    several = rows.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("__hi")).where("pivot != __hi")
    members = stored(rows.join(several, "bucket").select("bucket", "pivot", "key").distinct(), "members")
    wanted = members.select("key").distinct()
    nodes = (
        probably_listed(signed.select("key", F.col("n_shingles").alias("n"), "registers"), F.col("key"), wanted, "key")
        .groupBy("key").agg(F.first("n").alias("n"), F.first("registers").alias("registers"))
    )
    keyed = source.select(text_key(F.col("text"), seed).alias("key"), text_key(F.col("text"), seed + 1).alias("check"), "text")
    for level, clash in enumerate(clashes, 1):
        keyed = _told_apart(keyed, clash, level)
    texts = stored(
        probably_listed(keyed, F.col("key"), wanted, "key")
        .groupBy("key").agg(F.first("text").alias("text"))
        .join(wanted, "key", "left_semi")
        .select("key", F.length("text").alias("n_chars"), "text"),
        "texts",
    )
    pairs = members.where("pivot != key").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    edges = stored(_verified(_likely(pairs, nodes, similarity), texts, words, numerator, denominator), "links")
    labels = connected(edges, "a", "b")

    named = members.where("pivot != key").join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "bucket", "key", F.coalesce("label", "key").alias("label")
    )
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    rest = stored(named.join(mixed.select("bucket"), "bucket", "left_semi"), "rest")
    more = stored(_between(rest, texts, words, numerator, denominator, block_chars), "links")
    if not more.isEmpty():
        labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), "a", "b")

    group = F.when(F.col("n_shingles") > 0, F.coalesce("label", "key"))
    placed = signed.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "doc_id", "check", "n_shingles", group.alias("group")
    )
    first = placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return placed.join(first, "group", "left").select(
        "doc_id", "check", "n_shingles",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, **settings) -> DataFrame:
    """``docs`` without the rows that another document of their component stands for.

    The rows to drop are known by id and text; only rows that may be among them move.
    """
    found = near_duplicates(docs, doc_id, text, seed=seed, **settings)
    check = text_key(F.col(f"`{text}`"), seed + 1)
    gone = found.where(~F.col("kept")).select(F.struct("doc_id", "check").alias("gone"))
    return without(docs, F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), check.alias("check")), stored(gone, "gone"), "gone")
