"""Dealt operators against brute force on small tables with nulls, copies and clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditweave.llm import bpe, fingerprint, mixing, near_dedup, quality, suffixes, token_files, url_filter
from auditweave.llm.common import shared_path

BASE = [f"word{i}" for i in range(120)]


def _texts():
    near = BASE[:60] + ["changed"] + BASE[61:]
    other = [f"other{i}" for i in range(40)]
    return [
        (1, " ".join(BASE)), (2, " ".join(near)), (3, " ".join(BASE)), (4, None), (5, ""), (6, "two words"),
        (7, " ".join(other + BASE[20:90] + other[::-1])), (8, "x " * 3_000), (6, "two words"), (None, "no id at all"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a" if (i or 0) % 2 else None, 0, 1) for i, t in _texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, size int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_near_duplicates(docs, empty):
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words=3).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (7, 7, True)} <= found
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 1, 4, 5, 6, 6, 7, 8]


def test_passages(docs, empty):
    rows = suffixes.repeated_passages(docs)
    found = {tuple(r) for r in rows.collect()}
    assert (3, 0, 120, 1, 0) in found and (7, 40, 110, 1, 20) in found
    assert {r[0] for r in found} == {2, 3, 7}
    cut = {r.doc_id: r.text for r in suffixes.remove_passages(docs, rows).collect()}
    assert cut[3] == "" and "word20" not in cut[7].split() and cut[8] == "x " * 3_000
    assert suffixes.repeated_passages(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprint.neighbour_fingerprints(docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by_id[1].fingerprint == by_id[3].fingerprint and by_id[4].fingerprint == ""
    assert by_id[3].near_next > 0.9 and 0.0 <= by_id[7].near_edited <= 1.0
    assert fingerprint.neighbour_fingerprints(empty).count() == 0


def test_bpe_and_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode(docs, path, decoded="decoded").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0
    source = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(source)
    target = shared_path(spark, "test-tokens")
    token_files.write(docs, target, source, end_id=2)
    rows = sorted(token_files.read(spark, target).collect(), key=lambda r: r.start)
    texts = sorted(_texts(), key=lambda r: (r[0] or 0, r[1] or ""))
    assert [r.ids for r in rows] == [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in texts]


def test_mix(docs, empty):
    sized = mixing.sizes_of(docs)
    rows = mixing.mix_table(sized, mixing.plan_mix(sized)).collect()
    assert len(rows) == 10 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert all(r["target"] <= 3 * r["source_size"] for r in rows)
    nothing = mixing.sizes_of(empty)
    assert mixing.mix_table(nothing, mixing.plan_mix(nothing)).count() == 0


def test_split_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 7), (3, 0), (4, 81)], "place int, blocks long")
    rows = mixing.split_quotas(quotas, 8).collect()
    assert {s: sum(r.blocks for r in rows if r.shard == s) for s in range(8)} == dict.fromkeys(range(8), 16)
    assert [sum(r.blocks for r in rows if r.place == p) for p in (1, 2, 3, 4)] == [40, 7, 0, 81]


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://c.com/y", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'), (2, None, None),
         (3, "http://k.io/v", "<link rel=canonical href=//x.net/><link rel=canonical href=//s.org/fr/1>")],
        "page_id long, url string, html string",
    )
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.default_rules(pages)).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scores = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"]).collect()
    assert len(scores) == 10 and np.allclose([r.score for r in scores], 0.5)


def test_quality_draws_the_smallest_hashes_of_each_label(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(500)]
    known = spark.createDataFrame(rows, "doc_id long, label int")
    found = quality.drawn(known, 40)
    assert "TakeOrderedAndProject" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert plan.rindex("TakeOrderedAndProject(limit=40") > plan.index("Window")  # cut before the rows are ranked
    places = {r.doc_id: r.place for r in known.select("doc_id", F.xxhash64(F.lit(1), "doc_id").alias("place")).collect()}
    wanted = {(i, x) for x in (0, 1) for i in sorted((i for i, y in rows if y == x), key=lambda i: (places[i], i))[:20]}
    assert {tuple(r) for r in found.collect()} == wanted


def test_quality_takes_all_passages_if_asked(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality.AttentionNet, "fit", lambda self, bags, labels, **_: sizes.append(sorted(map(len, bags))) or self)
    frame = spark.createDataFrame([(1, "word " * 128 * 100), (2, "other " * 128 * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert not any(r.held for r in frame.select(quality.held_out(F.col("doc_id")).alias("held")).collect())
    quality.fit(frame, labels)
    quality.fit(frame, labels, passages=None)
    assert sizes == [[3, 64], [3, 100]]


def test_near_duplicates_of_few_shingles(spark):
    # 4 and 5 shingles, 4 in common; their sketches have no band in common
    words = [f"s166840t{j}" for j in range(9)]
    frame = spark.createDataFrame([(1, " ".join(words[:8])), (2, " ".join(words)), (3, "x y z")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    draw = np.random.default_rng(2)
    for n in range(1, near_dedup.FEW + 1):
        for share in (80, 85):
            for _ in range(20):
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
                other = draw.integers(0, 2**63, n, dtype=np.uint64)
                common = int(draw.integers(0, n + 1))
                b = np.unique(np.concatenate([a[draw.permutation(len(a))[:common]], other[: draw.integers(0, n - common + 1)]]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= share * (len(a) + len(b) - both):
                    assert np.intersect1d(near_dedup.exact_keys(a, share, 100), near_dedup.exact_keys(b, share, 100)).size


def test_texts_of_equal_hash(spark, docs, monkeypatch):
    wanted = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.near_duplicates(docs, words=3).collect())
    kept = sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect())
    real = near_dedup.text_key
    monkeypatch.setattr(near_dedup, "text_key", lambda text, seed: F.lit(7).cast("long") if seed == 1 else real(text, seed))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.near_duplicates(docs, words=3).collect())
    assert got == wanted
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect()) == kept


def test_outputs_replace_their_namesakes(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = {(r.doc_id, r.text): (r.ids, r.decoded) for r in bpe.encode(docs, path, decoded="decoded").collect()}
    taken = docs.withColumnsRenamed({"key": "IDS", "size": "decoded"})
    again = bpe.encode(taken, path, decoded="decoded")
    assert [c.lower() for c in again.columns].count("ids") == 1 and again.columns.count("decoded") == 1
    assert {(r.doc_id, r.text): (r.ids, r.decoded) for r in again.collect()} == plain
    back = bpe.decode(again, path)
    assert {(r.doc_id, r.text): r.decoded for r in back.collect()} == {k: v[1] for k, v in plain.items()}
    net = quality.AttentionNet(20)
    scored = quality.score(docs.withColumnRenamed("key", "Score"), net)
    assert {(r.doc_id, r.score) for r in scored.collect()} == {(r.doc_id, r.score) for r in quality.score(docs, net).collect()}
    plan = mixing.plan_mix(mixing.sizes_of(docs))
    copies = plan.copies(docs.withColumnRenamed("key", "shard"))
    assert copies.columns.count("shard") == 1 and copies.count() == plan.copies(docs).count()
