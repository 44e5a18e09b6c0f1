"""LM scoring by masked pseudo-likelihood of a bidirectional window network.

Every word is predicted from the two words before and the two after it; a document's score
is the sum of the logarithms of these conditional probabilities.

Word counts cover all documents: they are summed in Spark, the ``vocabulary`` most frequent
words are known to the network by themselves and all others by one of 256 hash groups. The
network predicts one of 128 classes (frequent words alone, others by hash); a word's share
in its class is its own count over the class's, for rare words by a join with the counts,
so probabilities of all words are proper. Words that were not counted share the one
occurrence that every group has more. The network is trained in
numpy on masked words of every document: in each round every task runs gradient steps over
its documents from the common weights, and the weights are averaged by the number of masked
words. Weights are cut into pieces that Spark deals out, so no task sees all of them.

Sizes on the driver and in tasks are those of the vocabulary and the network, not of the
corpus. Each task's steps depend on which documents it holds, so weights vary slightly with
the partitioning of the input; for the same files and settings they are the same.

Defined cases: null and empty texts have no words, score 0 and no mean; documents without
``doc_id`` and repeated rows are scored as any other; edges of a text are padded by one
reserved word; without any words every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditweave.llm.common import BATCH_BYTES, slim, stored
from auditweave.llm.words import Reader, mix

VOCABULARY, GROUPS, CLASSES, OWN_CLASSES, SIZE, REACH = 8_192, 256, 128, 96, 16, 2
ROUNDS, MASKED, BATCH, RATE = 2, 0.15, 512, 0.3


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word hash in the whole corpus; summed per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for texts in _texts(batches, 0):
            hashes = np.concatenate([reader.words(t)[2] for t in texts])
            words, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[bytes]]:
    for batch in batches:
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            found = batch.column(column).slice(at, step).to_pylist()
            yield [(t or "").encode("utf-8", "surrogatepass") for t in found]


class Vocabulary:
    """Ids, classes and within-class probabilities of words.

    ``share`` of a group is that of one occurrence; ``table`` has the counts of its words.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, group_counts: np.ndarray, table: DataFrame | None = None) -> None:
        self.table = table
        order = np.lexsort((words, -counts))
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        by_hash = np.argsort(words)
        self.words, self.rank = words[by_hash], rank[by_hash]
        n = len(words)
        self.pad = n + GROUPS
        # where the words of each leading 16 bits begin, and the most of them that share these bits
        begin = np.searchsorted(self.words, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.begin, self.probes = begin, int(np.diff(begin, append=n).max())
        self.guarded = np.append(self.words, np.uint64(2**64 - 1))
        rest = CLASSES - OWN_CLASSES
        self.classes = np.concatenate([
            np.where(np.arange(n) < OWN_CLASSES, np.arange(n), OWN_CLASSES + mix(words[order]) % np.uint64(rest)).astype(np.int64),
            OWN_CLASSES + np.arange(GROUPS) % rest, [0],
        ])
        # one more occurrence for every group, so that words of later texts have a probability
        mass = np.concatenate([counts[order], group_counts + 1, [0]]).astype(np.float64)
        total = np.bincount(self.classes, weights=mass, minlength=CLASSES)
        single = np.concatenate([counts[order], np.ones(GROUPS), [0]])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.share = np.log(single / total[self.classes])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # tasks have no tables

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        group = (len(self.words) + (mix(hashes) % np.uint64(GROUPS)).astype(np.int64))
        if not len(self.words):
            return group
        at = self.begin[hashes >> np.uint64(48)]
        for _ in range(self.probes):
            at += self.guarded[at] < hashes
        at = np.minimum(at, len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.rank[at], group)


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The most frequent words and the sums of the others by group, from stored counts."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(size)
    rows = top.collect()
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    found = np.array([r["n"] for r in rows], dtype=np.int64)
    known = np.sort(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(GROUPS, dtype=np.int64)
        for batch in batches:
            hashes, count = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            rare = ~np.isin(hashes, known)
            group = (mix(hashes[rare]) % np.uint64(GROUPS)).astype(np.int64)
            mass += np.bincount(group, weights=count[rare], minlength=GROUPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(mass)], names=["g", "mass"])

    groups = counts.mapInArrow(run, "g long, mass long").groupBy("g").agg(F.sum("mass").alias("mass")).collect()
    group_counts = np.zeros(GROUPS)
    for r in groups:
        group_counts[r["g"]] = r["mass"]
    return Vocabulary(words, found, group_counts, counts)


class WindowNet:
    """Context words, each through a table and a weight of its place, to class scores."""

    def __init__(self, words: int, seed: int = 1) -> None:
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.5, (words, SIZE)).astype(np.float32)
        self.places = np.ones((2 * REACH, SIZE), dtype=np.float32)
        self.hidden = draw.normal(0, SIZE**-0.5, (SIZE, SIZE)).astype(np.float32)
        self.hidden_b = np.zeros(SIZE, dtype=np.float32)
        self.out = np.zeros((SIZE, CLASSES), dtype=np.float32)
        self.out_b = np.zeros(CLASSES, dtype=np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.places, self.hidden, self.hidden_b, self.out, self.out_b]

    def load(self, values: np.ndarray) -> None:
        at = 0
        for part in self.parts():
            part[...] = values[at : at + part.size].reshape(part.shape)
            at += part.size

    def forward(self, context: np.ndarray):
        looked = self.table[context]
        mixed = np.einsum("npd,pd->nd", looked, self.places)
        h = np.tanh(mixed @ self.hidden + self.hidden_b)
        scores = h @ self.out + self.out_b
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return looked, mixed, h, scores

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the log loss of the target classes."""
        n = len(target)
        looked, mixed, h, scores = self.forward(context)
        d = np.exp(scores)
        d[np.arange(n), target] -= 1.0
        d /= n
        d_h = (d @ self.out.T) * (1.0 - h * h)
        d_mixed = d_h @ self.hidden.T
        self.out -= rate * (h.T @ d)
        self.out_b -= rate * d.sum(axis=0)
        self.hidden -= rate * (mixed.T @ d_h)
        self.hidden_b -= rate * d_h.sum(axis=0)
        d_places = np.einsum("npd,nd->pd", looked, d_mixed)
        d_looked = d_mixed[:, None, :] * self.places
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        sums = np.add.reduceat(d_looked.reshape(-1, SIZE)[order], starts, axis=0)
        self.table[flat[order][starts]] -= rate * 8.0 * sums
        self.places -= rate * d_places


class WindowScorer:
    """Log probabilities of a trained network: each place's share of the hidden layer is a table of its own."""

    def __init__(self, net: WindowNet, vocab: Vocabulary) -> None:
        self.net, self.vocab = net, vocab
        self.places = [(net.table * net.places[p]) @ net.hidden for p in range(2 * REACH)]
        # no score is further from 0 than this; beyond it exponentials of single floats could overflow
        self.wide = float((np.abs(net.out).sum(axis=0) + np.abs(net.out_b)).max()) > 80.0

    def totals(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum over the words of each text, given by their ids."""
        net, vocab, sizes = self.net, self.vocab, np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        places = np.arange(len(owner)) + REACH * (2 * owner + 1)
        padded = np.full(len(owner) + 2 * REACH * len(texts), vocab.pad)
        own = np.concatenate(texts)
        padded[places] = own
        found = np.empty(len(own))
        for begin in range(0, len(own), 4_096):
            at, words = places[begin : begin + 4_096], own[begin : begin + 4_096]
            h = net.hidden_b + sum(
                table[padded[at + step]] for table, step in zip(self.places, [*range(-REACH, 0), *range(1, REACH + 1)])
            )
            scores = np.tanh(h, out=h) @ net.out + net.out_b
            if self.wide:
                scores -= scores.max(axis=1, keepdims=True)
            wanted = scores[np.arange(len(at)), vocab.classes[words]]
            found[begin : begin + len(at)] = wanted - np.log(np.exp(scores, out=scores).sum(axis=1)) + vocab.share[words]
        return np.bincount(owner, weights=found, minlength=len(texts))


def contexts(ids: np.ndarray, pad: int, at: np.ndarray) -> np.ndarray:
    """The words on both sides of the positions ``at``."""
    padded = np.concatenate([np.full(REACH, pad), ids, np.full(REACH, pad)])
    sides = np.array([*range(REACH), *range(REACH + 1, 2 * REACH + 1)])
    return padded[at[:, None] + sides]


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, seed: int = 1, pieces: int = 64) -> WindowNet:
    """Weights averaged over all tasks after each round; a task's weight is its masked words."""
    net = WindowNet(vocab.pad + 1, seed)
    length = len(net.flat())
    piece = -(-length // pieces)
    for turn in range(rounds):
        start = net.flat()

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own, reader = WindowNet(vocab.pad + 1, seed), Reader()
            own.load(start)
            done, held, targets, waiting = 0, [], [], 0
            for texts in _texts(batches, 0):
                for text in texts:
                    hashes = reader.words(text)[2]
                    # which words are masked depends on the text alone
                    chance = mix(hashes + np.arange(len(hashes), dtype=np.uint64) * np.uint64(2 * turn + 3)) >> np.uint64(11)
                    at = np.flatnonzero(chance < MASKED * 2.0**53)
                    if not len(at):
                        continue
                    ids = vocab.ids(hashes)
                    held.append(contexts(ids, vocab.pad, at))
                    targets.append(vocab.classes[ids[at]])
                    waiting += len(at)
                    if waiting >= 16 * BATCH:
                        done += _steps(own, held, targets, turn)
                        held, targets, waiting = [], [], 0
            if held:
                done += _steps(own, held, targets, turn)
            if done:
                values = np.pad(own.flat(), (0, piece * pieces - length)).reshape(pieces, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(pieces)), pa.array(np.full(pieces, float(done))), pa.array([v.tobytes() for v in values], type=pa.binary())],
                    names=["piece", "n", "weights"],
                )

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for key, n, weights in zip(*[c.to_pylist() for c in batch.columns]):
                    kept = sums.setdefault(key, [0.0, np.zeros(piece)])
                    kept[0] += n
                    kept[1] += n * np.frombuffer(weights, dtype=np.float32)
            for key, (n, total) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], type=pa.binary())],
                    names=["piece", "n", "weights"],
                )

        kind = "piece long, n double, weights binary"
        local = docs.select("text").mapInArrow(run, kind)
        rows = local.repartition("piece").sortWithinPartitions("piece", "n", "weights").mapInArrow(average, kind).collect()
        if not rows:
            break
        net.load(np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["piece"])])[:length])
    return net


def _steps(net: WindowNet, held: list[np.ndarray], targets: list[np.ndarray], turn: int) -> int:
    context, target = np.concatenate(held), np.concatenate(targets)
    order = np.random.default_rng(len(target)).permutation(len(target))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        net.step(context[part], target[part], RATE / (1 + turn))
    return len(target)


def score(docs: DataFrame, vocab: Vocabulary, net: WindowNet) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_likelihood`` (natural logarithm) and its mean per word."""
    names = ["doc_id", "n_words", "total", "rare", "times"]

    def of(reader: Reader, scorer: WindowScorer, texts: list[bytes]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        hashes = [reader.words(t)[2] for t in texts]
        every = np.concatenate(hashes)
        ends = np.cumsum([len(h) for h in hashes])
        ids = np.split(vocab.ids(every), ends[:-1])
        for own, numbers, total in zip(hashes, ids, scorer.totals(ids).tolist()):
            rare, times = np.unique(own[numbers >= len(vocab.words)], return_counts=True)
            yield len(numbers), total, rare.view(np.int64), times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, scorer = Reader(), WindowScorer(net, vocab)
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                sizes, totals, rare, times = zip(*(row for i in range(0, len(texts), 32) for row in of(reader, scorer, texts[i : i + 32])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, type=pa.int64()), pa.array(totals, type=pa.float64()),
                     pa.array(rare, type=pa.list_(pa.int64())), pa.array(times, type=pa.list_(pa.int64()))],
                    names=names,
                )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, total double, rare array<long>, times array<long>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # a rare word counted n times has n times the share of one occurrence
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times")).alias("word", "times"))
    own = rare.join(vocab.table.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("own"))
    total = F.col("total") + F.coalesce("own", F.lit(0.0))
    return scored.join(own, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")
    )


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = VOCABULARY, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Count, train and score over all documents."""
    source = slim(docs, doc_id=doc_id, text=text)
    vocab = vocabulary(stored(word_counts(source), "words"), size)
    return score(source, vocab, train(source, vocab, rounds, seed))
