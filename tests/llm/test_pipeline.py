"""Stages of the pipeline, neighbours and LM scores against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auditweave.llm import lm_score, multi_index, near_dedup, quality, suffixes
from auditweave.llm.common import stored, table

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text, n=5):
    words = WORD.findall(regex.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def _groups(texts):
    """Smallest id that each document reaches over links of similarity 0.8."""
    sets, found, first = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in sorted(texts):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in first[s]:
                shared[j] += 1
            first[s].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                found[b] = a
    return {i: root(i) for i in texts}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def _by_id(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stage_columns(spark, sf_dir, stages):
    wanted = table(spark, sf_dir, "documents").columns
    assert all(s.columns == wanted for s in stages[:-1])


def test_quality_keeps_clean_documents(spark, sf_dir, stages):
    kept = set(_by_id(stages[0]))
    labels = table(spark, sf_dir, "labels").where(quality.held_out(F.col("doc_id"))).collect()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels if r.quality is not None]
    assert right and np.mean(right) >= 0.95


def test_one_of_each_group_stays(stages):
    before, after = _by_id(stages[0]), _by_id(stages[1])
    groups = _groups(before)
    assert set(after) == {i for i, g in groups.items() if i == g}


def test_passages_are_cut_once(stages):
    before, after = _by_id(stages[1]), _by_id(stages[2])
    assert set(before) == set(after)
    held = defaultdict(set)
    for i, text in after.items():
        words = WORD.findall(text or "")
        for at in range(len(words) - 49):
            held[tuple(words[at : at + 50])].add(i)
    assert not [w for w, ids in held.items() if len(ids) > 1]
    seen = {w for t in after.values() for w in WORD.findall(t or "")}
    assert seen == {w for t in before.values() for w in WORD.findall(t or "")}
    for r in stages[2].select("text", "n_chars").collect():
        assert r.n_chars == len(r.text or "")


def test_passages_of_edited_copies(spark):
    draw, rows = np.random.default_rng(11), []
    for group in range(60):
        base = [f"g{group}w{i}" for i in range(80)]
        for copy in range(int(draw.integers(3, 7))):
            words = list(base)
            words[int(draw.integers(80))] = f"new{group}x{copy}"
            rows.append((len(rows), " ".join(words)))
    # the earliest shares 39 words with each of the others, these share 56
    base = [f"b{i}" for i in range(60)]
    rows += [(1000 + at, " ".join("changed" if i == at else w for i, w in enumerate(base))) for at in (1, 3)]
    rows.append((999, " ".join("changed" if i == 20 else w for i, w in enumerate(base))))
    # a document that has the beginning of a passage twice, the whole of it at the second place
    line = [f"c{i}" for i in range(60)]
    rows.append((2000, " ".join([*line[10:40], "x", "y", *line])))
    rows.append((2001, " ".join(["z", *line, "q"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got, wanted, held = defaultdict(set), defaultdict(set), set()
    for r in suffixes.repeated_passages(frame).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    for i, text in sorted(rows):
        words = text.split()
        windows = [tuple(words[at : at + 50]) for at in range(len(words) - 49)]
        for at, window in enumerate(windows):
            if window in held:
                wanted[i].update(range(at, at + 50))
        held.update(windows)
    assert len(wanted) > 50
    assert got == wanted


def test_a_passage_in_many_documents(spark, monkeypatch):
    # 2,000 documents share 60 words between four left and four right contexts and words of their own
    monkeypatch.setattr(suffixes, "COMMON_ROWS", 100)
    shared, rows = [f"p{i}" for i in range(60)], []
    for at in range(2_000):
        left, right = [f"l{at % 4}x{i}" for i in range(20)], [f"r{at // 4 % 4}x{i}" for i in range(20)]
        own = [f"own{at}x{i}" for i in range(5)]
        rows.append((at, " ".join([*own, *left, *shared, *right, *own])))
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) <= 3 * len(rows)
    texts, got = {i: t.split() for i, t in rows}, defaultdict(set)
    for r in found:
        n = r.end_word - r.start_word
        assert n >= 50 and r.source_doc_id < r.doc_id
        assert texts[r.doc_id][r.start_word : r.end_word] == texts[r.source_doc_id][r.source_word : r.source_word + n]
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert 0 not in got and got[1] == set(range(25, 105)) and all(got[at] == set(range(5, 105)) for at in range(16, 2_000))


def test_encoding_equals_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in stages[4].collect()}
    for i, text in _by_id(stages[3]).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_run_again_gives_the_same_rows(spark, sf_dir, stages):
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, stages[4].select("doc_id", "ids_sha256").collect()))


def _nearest(rows, every=50, top=5):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=float)
    norms = np.sqrt((vectors**2).sum(axis=1))
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        score = vectors @ vectors[at] / (norms * norms[at])
        score[at] = -2
        order = np.lexsort((ids, -score))[:top]
        out[int(ids[at])] = [(int(ids[o]), float(score[o])) for o in order if o != at]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(400)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [None] * 8), (None, [1.0] * 8), (1200, [1.0])]
    schema = "vec_id long, embedding array<double>, score double"
    frame = spark.createDataFrame([(*r, 0.0) for r in [*rows, *odd, rows[50]]], schema)
    found = defaultdict(list)
    for r in sorted(multi_index.neighbours(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    wanted = _nearest(rows)
    assert set(found) == set(wanted)
    for q in wanted:
        assert [i for i, _ in found[q]] == [i for i, _ in wanted[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in wanted[q]], abs=1e-12)
    assert multi_index.neighbours(spark.createDataFrame([], schema)).count() == 0


def test_recall_of_neighbours(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    usable = multi_index.usable(frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    rows = [(r.id, r.vector) for r in usable.collect()]
    wanted = _nearest(rows)
    found = {(r.query_id, r.vec_id) for r in multi_index.neighbours(frame).collect()}
    recall = np.mean([(q, i) in found for q, near in wanted.items() for i, _ in near])
    assert recall >= 0.9


def test_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") > 400)
    rows = [tuple(r) for r in docs.collect()]
    draw = np.random.default_rng(3)
    mixed = [(-i, " ".join(draw.permutation(t.split()))) for i, t in rows if i]
    vocab = lm_score.vocabulary(lm_score.word_counts(docs))
    net = lm_score.train(docs, vocab)
    frame = spark.createDataFrame([*rows, *mixed, (10**9, None), (10**9 + 1, ""), (None, "a b")], "doc_id long, text string")
    result = lm_score.score(frame, vocab, net)
    total = next(c for c, kind in result.dtypes if kind == "double")
    got = {r["doc_id"]: r[total] for r in result.collect()}
    assert len(got) == len(rows) + len(mixed) + 3 and got[10**9] == got[10**9 + 1] == 0
    assert all(got[i] < 0 for i, _ in rows)
    assert np.mean([got[i] > got[-i] for i, _ in rows if i]) > 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.pseudo_likelihood(empty).count() == 0


def test_lm_scores_use_the_count_of_each_rare_word(spark):
    times = {f"w{i}": i + 1 for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(times.items())], "doc_id long, text string")
    vocab = lm_score.vocabulary(lm_score.word_counts(docs), 10)
    net = lm_score.train(docs, vocab)
    alone = [*times, "never"]
    frame = spark.createDataFrame([*enumerate(alone), (500, "w7"), (None, "w7 w7")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lm_score.score(frame, vocab, net).collect()}
    by_class = defaultdict(list)
    for i, word in enumerate(alone):
        own = vocab.classes[vocab.ids(lm_score.Reader().words(word.encode())[2])[0]]
        by_class[own].append(got[i] - np.log(times.get(word, 1)))
    assert max(map(len, by_class.values())) > 5 and len(got) == len(alone) + 2 and got[500] == pytest.approx(got[7])
    for values in by_class.values():
        assert values == pytest.approx([values[0]] * len(values), abs=1e-4)


def test_operators_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    assert suffixes.remove_passages(empty, suffixes.repeated_passages(empty), n_chars="n_chars").count() == 0


def test_rows_of_a_crowd_grow_in_proportion(spark):
    shared = " ".join(f"shared{i}" for i in range(60))

    def made(n):
        rows = [(i, " ".join(f"own{i}x{j}" for j in range(40)) + " " + shared) for i in range(n)]
        found = suffixes._suffixes(spark.createDataFrame(rows, "doc_id long, text string"), 50)
        return found.count(), suffixes._neighbours(found).count()

    (few, crowd), (many, larger) = made(100), made(200)
    assert 100 <= crowd <= few and larger <= many
    assert larger <= 2.1 * crowd
