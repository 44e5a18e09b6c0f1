"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of 128 words. Every passage is described by counts of byte
classes and by how its words repeat, encoded by a hidden layer, and weighted by gated
attention; the weighted mean of the encodings gives the score. Only document labels are
needed. Scores depend on the text alone.

The network is fitted in numpy on at most ``sample`` labelled documents (those with the
smallest hashes of their ids, half of them of each label if there are enough), of each at
most ``passages`` passages evenly spread (``None``: all). Scoring uses all passages of all texts.

Defined cases: null and empty texts are one passage without words and get a score as any
other; labels other than 0 and 1 and labels without a document are ignored; a document
labelled both ways counts as 0; without labels of both kinds every score is the share of
label 1 (0.5 without any). Rows without ``doc_id`` are scored and never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from auditweave.llm.common import BATCH_BYTES, free_name, kept_beside, slim
from auditweave.llm.words import Reader

PASSAGE_WORDS, SAMPLE, SAMPLE_PASSAGES, CUT = 128, 6_000, 64, 0.3
_MARKS = b"!|%$&#*@~^_=+<>{}[]\\/"


class Passages:
    """Feature rows of the passages of a text."""

    def __init__(self, words: int = PASSAGE_WORDS) -> None:
        self.n = words
        self.reader = Reader(lower=True)
        kinds = np.zeros(256, dtype=np.int8)
        kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 1, 2, 3, 4
        kinds[[9, 10, 11, 12, 13, 32]] = 5
        kinds[list(_MARKS)] = 6
        kinds[list(b".,")] = 7
        self.kinds = kinds

    def of(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        starts, ends, hashes = self.reader.words(data)
        if not len(starts):
            empty = np.zeros((1, 20), dtype=np.float32)
            empty[0, 0] = 1.0
            return empty
        first = np.arange(0, len(starts), self.n)
        kinds = self.kinds[np.frombuffer(data, dtype=np.uint8)]
        begin = starts[first]
        begin[0] = 0
        length = np.diff(np.append(begin, len(data))).astype(np.float64)
        rows = [np.zeros(len(first))]
        rows += [np.add.reduceat(kinds == k, begin, dtype=np.float64) / length for k in range(8)]
        lines = np.add.reduceat(np.frombuffer(data, dtype=np.uint8) == 10, begin, dtype=np.float64) / length
        sizes = (ends - starts).astype(np.float64)
        count = np.diff(np.append(first, len(starts))).astype(np.float64)
        mean = np.add.reduceat(sizes, first) / count
        spread = np.sqrt(np.maximum(0.0, np.add.reduceat(sizes * sizes, first) / count - mean * mean))
        capital = (kinds[starts] == 1).astype(np.float64)
        full = kinds[np.maximum(ends - 1, 0)]
        rows += [
            lines, mean, spread,
            np.add.reduceat(capital, first) / count,
            np.add.reduceat((full == 6).astype(np.float64), first) / count,
            np.add.reduceat((sizes == 1).astype(np.float64), first) / count,
        ]
        place = np.arange(len(starts)) // self.n
        same_next = np.append((hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1]), False)
        rows.append(np.add.reduceat(same_next.astype(np.float64), first) / count)
        for values in (hashes, hashes + np.roll(hashes, -1) * np.uint64(0x9E3779B97F4A7C15)):
            order = np.lexsort((values, place))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (values[order][1:] != values[order][:-1]) | (place[order][1:] != place[order][:-1])
            rows.append(np.add.reduceat(new.astype(np.float64), first) / count)
        rows.append(np.full(len(first), len(np.unique(hashes)) / len(hashes)))
        rows.append(np.log1p(count))
        return np.stack(rows, axis=1).astype(np.float32)


class AttentionNet:
    """Encoder, gated attention and output, fitted with Adam on the log loss."""

    def __init__(self, features: int, hidden: int = 24, gate: int = 12, seed: int = 1) -> None:
        draw = np.random.default_rng(seed)
        self.weights = {
            "enc": draw.normal(0, features**-0.5, (features, hidden)), "enc_b": np.zeros(hidden),
            "att": draw.normal(0, hidden**-0.5, (hidden, gate)), "gate": draw.normal(0, hidden**-0.5, (hidden, gate)),
            "pick": draw.normal(0, gate**-0.5, gate), "out": draw.normal(0, hidden**-0.5, hidden), "out_b": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.constant: float | None = None

    def forward(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        w = self.weights
        x = np.clip((rows - self.mean) / self.scale, -8.0, 8.0)
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["att"]), 1.0 / (1.0 + np.exp(-(h @ w["gate"])))
        raw = (v * u) @ w["pick"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        p = 1.0 / (1.0 + np.exp(-(z @ w["out"] + w["out_b"])))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def gradients(self, s: dict, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        w, n = self.weights, len(labels)
        d_logit = (s["p"] - labels) / n
        d_z = np.repeat(d_logit[:, None] * w["out"], sizes, axis=0)
        along = (d_z * s["h"]).sum(axis=1)
        d_raw = s["a"] * (along - np.repeat(np.add.reduceat(s["a"] * along, starts), sizes))
        d_v = d_raw[:, None] * w["pick"] * s["u"] * (1 - s["v"] ** 2)
        d_u = d_raw[:, None] * w["pick"] * s["v"] * s["u"] * (1 - s["u"])
        d_h = (d_z * s["a"][:, None] + d_v @ w["att"].T + d_u @ w["gate"].T) * (1 - s["h"] ** 2)
        return {
            "enc": s["x"].T @ d_h, "enc_b": d_h.sum(axis=0), "att": s["h"].T @ d_v, "gate": s["h"].T @ d_u,
            "pick": (s["v"] * s["u"]).T @ d_raw, "out": s["z"].T @ d_logit, "out_b": np.array([d_logit.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.005, seed: int = 1) -> AttentionNet:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                rows, starts, sizes = joined([bags[i] for i in part])
                grads = self.gradients(self.forward(rows, starts, sizes), labels[part], starts, sizes)
                step += 1
                slow = rate * (1.0 - epoch / epochs)
                for k, g in grads.items():
                    g = g + 1e-4 * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return self.forward(*joined(bags))["p"]


def joined(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(known: DataFrame, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """(doc_id, label) of at most ``sample`` rows, of each label in turn the smallest hashes.

    Each task keeps ``sample`` rows of a label at most, so the ranked rows are twice that.
    """
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    least = [known.where(F.col("label") == x).orderBy(place, "doc_id").limit(sample) for x in (0, 1)]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(place, "doc_id"))
    return least[0].union(least[1]).withColumn("rank", rank).orderBy("rank", "label").limit(sample).select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, seed: int = 1, passages: int | None = SAMPLE_PASSAGES) -> AttentionNet:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    known = (
        slim(labels, doc_id="doc_id", label=label)
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    chosen = drawn(known, sample, seed)
    texts = slim(docs, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Passages()
        for batch in batches:
            bags = [maker.of(t) for t in batch.column(1).to_pylist()]
            if passages is not None:
                bags = [b if len(b) <= passages else b[np.linspace(0, len(b) - 1, passages).astype(int)] for b in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b.tobytes() for b in bags], type=pa.binary())],
                names=["doc_id", "label", "bag"],
            )

    rows = texts.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, bag binary").collect()
    rows = sorted({(r["doc_id"], r["label"], bytes(r["bag"])) for r in rows})
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, 20) for _, _, b in rows]
    return AttentionNet(20, seed=seed).fit(bags, np.array([x for _, x, _ in rows], dtype=float), seed=seed)


def score(docs: DataFrame, net: AttentionNet, text: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``keep``) with the score of each whole text.

    A column that is named like ``output`` is replaced by it.
    """
    kept = kept_beside(docs.columns if keep is None else keep, output)
    body = free_name([*kept, output], "__text")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(output)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Passages()
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores = net.score([maker.of(t) for t in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(scores)], names=[*kept, output])

    return rows.mapInArrow(run, schema)
