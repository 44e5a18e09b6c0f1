"""Fill-in-the-middle against plain slicing, and its exact round trip."""

import re
from hashlib import sha256

import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditweave.llm import fill_middle, queries

UNITS = regex.compile(f"({fill_middle.LINE})*+")
SCHEMA = "doc_id long, text string, n long, form string, output string, id string"


def by_hand(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, line by line, without a match object."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    head, inner, tail = ("".join(p) for p in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return len(lines), "spm", len(head), len(inner), f"<S>{tail}<P>{head}<M>{inner}"
    return len(lines), "psm", len(head), len(inner), f"<P>{head}<S>{tail}<M>{inner}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab\n\r<PSM>é😀 ", max_size=40))
def test_equals_slicing_and_gives_the_text_back(doc_id, text):
    made = fill_middle.transform(doc_id, text, UNITS, seed=7, rate=100, spm=50)
    assert made == by_hand(doc_id, text)
    assert fill_middle.rebuilt(made[4], made[1]) == text


@pytest.fixture(scope="module")
def frame(spark):
    texts = [None, "", "one line", "a\nb\n", "\n\n\n", "a <S> b\nc", "z<\n<\nP>\nq", "tail\nno end", "x\n" * 700_000, "é😀\n漢字\nend"]
    rows = [(i, t, i, "own", "own", "own") for i, t in enumerate(texts)] + [(3, "a\nb\n", 3, "own", "own", "own"), (None, "no\nid\n", 0, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_table_with_nulls_long_texts_and_clashing_names(frame):
    made = fill_middle.fill_in_middle(frame)
    rows = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    assert made.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"] and len(rows) == 12
    for r in rows:
        if r.id is not None:
            assert tuple(r[1:6]) == by_hand(r.id, texts[r.id])
        assert r.back == texts[r.id]
    assert {r.form for r in rows if r.id in (0, 1, 5)} == {"plain"}
    assert next(r.n for r in rows if r.id == 8) == 700_000


def test_empty_table_and_parameters(spark, frame):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.form for r in fill_middle.fill_in_middle(frame, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(frame, keep=["n"])
    words = fill_middle.fill_in_middle(frame, unit=r"\S++\s*+|\s++", markers=("[[p]]", "[[s]]", "[[m]]"))
    back = words.select("id", fill_middle.restored(F.col("output"), F.col("form"), ("[[p]]", "[[s]]", "[[m]]")).alias("back"))
    assert {(r.id, r.back) for r in back.collect()} == {(r.doc_id, r.text or "") for r in frame.collect()}


def test_markers_that_overlap_stay_plain():
    for doc_id in range(40):
        text = "bab\nba\nab\n"
        made = fill_middle.transform(doc_id, text, UNITS, seed=7, rate=100, spm=50, markers=("[", "a\na", "]"))
        assert fill_middle.rebuilt(made[4], made[1], ("[", "a\na", "]")) == text


def test_query_on_given_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_fill_in_middle(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
