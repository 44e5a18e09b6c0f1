"""Registered queries of the dealt operators with their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from auditweave.llm import bpe, centroids, fill_middle, fingerprint, hilbert, lm_score, mixing, multi_index, near_dedup, quality, suffixes, token_files, url_filter
from auditweave.llm.common import shared_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op1_repeated_passages")
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has, one row per passage."""
    return suffixes.repeated_passages(_documents(spark, sf_dir))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of its edit with the next document's beginning."""
    return fingerprint.neighbour_fingerprints(_documents(spark, sf_dir))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(_documents(spark, sf_dir), path, decoded="decoded", keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are alike at 85 of 100."""
    found = near_dedup.near_duplicates(_documents(spark, sf_dir), words=3, numerator=85, denominator=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of every fiftieth vector."""
    return multi_index.neighbours(table(spark, sf_dir, "embeddings"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, written to ORC and read back from the files."""
    path = shared_path(spark, "tokens")
    token_files.write(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path).select(
        "doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), token_files.crc32(F.col("ids")).alias("ids_crc32")
    )


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of each whole text under a network trained on all of them."""
    return lm_score.pseudo_likelihood(_documents(spark, sf_dir))


@query("op8_url_filter", url_filter.ORACLE)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of each page."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.default_rules(pages))


@query("op9_mix")
def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources weigh 1, 2, 3 in turn."""
    sized = mixing.sizes_of(_documents(spark, sf_dir))
    found = mixing.mix_table(sized, mixing.plan_mix(sized))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each whole text, learned from labels that are not held out."""
    docs = _documents(spark, sf_dir)
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, keep=["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


@query("op11_fill_in_middle", fill_middle.ORACLE)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, parts and digests of each text turned into a fill-in-the-middle example."""
    found = fill_middle.fill_in_middle(_documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_centroids", centroids.oracle())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of each whole vector after three rounds."""
    return centroids.assignment_table(centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op13_shards")
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document along a Hilbert curve over language, source and size."""
    return hilbert.shard_table(_documents(spark, sf_dir))
