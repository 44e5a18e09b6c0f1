"""The chunk encoder against the tokenizers library on odd and on marked texts."""

import public_tokenizers
import pyarrow as pa
import pytest

from auditweave.llm.token_files import ChunkEncoder

ODD = [
    "", " ", "  a", "a", "a ", "a  b", "a \n b", "\n\n x", "x <|endoftext|> y", "　 a", "é è", "a\t b",
    " lead one", "x" * 5_000 + " y", "end.\nNew line, again", "one, two; three: four.", "one, one, one,", "1,5 %% $x",
]


@pytest.fixture
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return ChunkEncoder(file.read())


def test_ids_are_the_library_s(encoder):
    expected = encoder.library(ODD)
    assert encoder.encode(ODD) == expected and encoder.encode(ODD[::-1]) == expected[::-1]
    assert [encoder.encode([t])[0] for t in ODD] == expected
    assert encoder.encode([]) == []


def test_words_with_marks_are_kept_once(encoder):
    text = "first " + " ".join(f"alpha{m} beta{m}" for m in ["", ".", ",", ";", ":", "!", "?", ".,"])
    assert encoder.encode([text]) == encoder.library([text])
    assert set(encoder.cache) == {"alpha", "beta"}


def test_each_word_of_a_batch_is_looked_up_once(encoder, monkeypatch):
    asked, words = [], encoder.words
    monkeypatch.setattr(encoder, "words", lambda found: asked.append(found) or words(found))
    chunks = ["alpha", "alpha.", "alpha,\nbeta!", "alpha\n", "élan", "élan;", "αβγ.", "x1.", "a,b", ".", ".\n", "two  words", ""]
    ids, starts = encoder.chunks(pa.array(chunks))
    assert [ids[a:b].tobytes() for a, b in zip(starts, starts[1:])] == encoder.library([f" {c}" for c in chunks])
    assert asked == [["alpha", "alpha\n", "élan", "αβγ.", "x1.", "a,b", ".", ".\n", "two  words", ""]]
