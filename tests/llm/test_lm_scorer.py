"""The scorer of whole texts against the network's own forward pass."""

import numpy as np

from auditweave.llm import lm_score


def _vocabulary(n: int) -> lm_score.Vocabulary:
    words = np.random.default_rng(3).integers(0, 2**64, n, dtype=np.uint64)
    words[:2] = 0, 2**64 - 1
    return lm_score.Vocabulary(words, np.arange(n, 0, -1), np.full(lm_score.GROUPS, 5.0))


def _net(vocab: lm_score.Vocabulary, scale: float) -> lm_score.WindowNet:
    net, draw = lm_score.WindowNet(vocab.pad + 1), np.random.default_rng(4)
    for part in (net.places, net.hidden_b, net.out, net.out_b):
        part[...] = draw.normal(0, scale, part.shape)
    return net


def test_scorer_sums_the_forward_pass_of_each_text():
    vocab, draw = _vocabulary(400), np.random.default_rng(5)
    texts = [draw.integers(0, vocab.pad, n) for n in (0, 1, 2, 3, 7, 9_000, 0, 500)]
    for scale, wide in ((1.0, False), (40.0, True)):
        net = _net(vocab, scale)
        scorer = lm_score.WindowScorer(net, vocab)
        assert bool(scorer.wide) == wide
        for got, ids in zip(scorer.totals(texts), texts, strict=True):
            scores = net.forward(lm_score.contexts(ids, vocab.pad, np.arange(len(ids))))[3]
            alone = scores[np.arange(len(ids)), vocab.classes[ids]].sum(dtype=np.float64) + vocab.share[ids].sum()
            assert np.isclose(got, alone, rtol=1e-5, atol=1e-3)


def test_word_ids_equal_a_plain_search():
    vocab = _vocabulary(400)
    near = vocab.words[1:-1]
    hashes = np.concatenate([vocab.words, near - np.uint64(1), near + np.uint64(1)])
    ids = vocab.ids(hashes)
    known = np.isin(hashes, vocab.words)
    assert known.sum() >= len(vocab.words) and (ids[~known] >= len(vocab.words)).all()
    assert (ids[: len(vocab.words)] == vocab.rank).all()
