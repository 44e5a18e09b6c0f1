"""Training corpus from the documents table, stage by stage.

Quality first, so that rejected texts are not compared; one document of each near-duplicate
group; passages that an earlier document has are cut out; sources are mixed to target
weights (documents are repeated or left out); the mix is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.llm import bpe, mixing, near_dedup, quality, suffixes
from auditweave.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut; learned from the labels that are not held out."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net, output="__score")
    return scored.where(F.col("__score") >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates (five words, 0.8)."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return suffixes.remove_passages(docs, suffixes.repeated_passages(docs), n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard, shuffled inside a shard."""
    plan = mixing.plan_mix(mixing.sizes_of(docs))
    return plan.write_order(plan.copies(docs, shard="__shard"), shard="__shard").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(docs, path, decoded="decoded", keep=["doc_id", "source"])
    return encoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No stage can be written in SQL (a trained network, sketches, suffixes, hash draws, BPE merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
