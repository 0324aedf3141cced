"""Words of any length enter the expected counts of pieces."""

import math

import numpy as np
import public_tokenizers
import pytest

from protospan.llm import lattice, textops

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CHINESE = "我们今天在这里讨论语言模型的训练数据和它们的质量问题以及如何处理没有空格的文字"


def counted(words, p):
    expected = np.zeros(p.size)
    (w,) = textops.segments(words)
    return lattice.forward(w, np.arange(len(words)), p, expected), expected


@pytest.mark.parametrize("window", [1, 5, 64])
def test_windows_give_what_short_words_give(window, monkeypatch):
    p = lattice.read_pieces(PIECES)
    words = [b"a", b"the", b"internationalisation", "été".encode(), b"\xff\x00q", CHINESE[:9].encode(), b"understandings", b"x1y2z3aaaaaaaaaaaaaaaaaaaaaaaa"]
    logs, expected = counted(words, p)
    monkeypatch.setattr(lattice, "LONG", 0)
    monkeypatch.setattr(lattice, "WINDOW", window)
    got_logs, got = counted(words, p)
    assert np.allclose(got_logs, logs) and np.allclose(got, expected, atol=1e-9)


def test_long_words_are_counted():
    p = lattice.read_pieces(PIECES)
    words = [CHINESE.encode(), b"understanding" * 5, b"internationalisation" * 100, b"ab" * 5000]
    logs, expected = counted(words, p)
    stop = math.log10(p.stop / (1 - p.stop))
    assert np.allclose(logs, [lattice._long_word(x, p) / math.log(10) + stop for x in words])
    size = np.zeros(p.size)
    for found in (p.inner, p.first):
        for piece, i in found.items():
            size[i] = len(piece)
    size[p.byte] = 1
    assert expected @ size == pytest.approx(sum(map(len, words)))


def test_learning_counts_words_without_blanks(spark):
    docs = spark.createDataFrame([(i, CHINESE) for i in range(1, 40)], "doc_id long, text string")
    before, after = lattice.read_pieces(PIECES), lattice.learn(docs, PIECES)[0].pieces
    used = [p for p in (before.inner.get(c.encode()) for c in set(CHINESE)) if p is not None]
    assert used and np.mean(after.weight[used] - before.weight[used]) > 1
    assert lattice.ROUNDS == 3


def test_the_share_of_own_weights_is_fitted():
    p = lattice.read_pieces(PIECES)
    rng = np.random.default_rng(2)
    expected = np.where(rng.random(p.size) < 0.1, rng.gamma(0.3, 1000, p.size), 0) * np.isfinite(p.place)
    before = p.with_counts(expected, expected.sum() / 3)
    held = np.where(rng.random(p.size) < 0.05, 1.0, 0) * np.isfinite(p.place) + rng.poisson(expected / 50)
    after = before.fitted(held)

    def likely(part, offset):
        return (held[held > 0] * np.log((part * lattice.falling(p.place, offset) + (1 - part) * before.share)[held > 0])).sum()

    best = max(((likely(a, o), a, o) for o in lattice.OFFSETS for a in np.linspace(0.001, 0.999, 400)))
    assert likely(after.part, after.offset) >= best[0] - 1e-3 * abs(best[0]) and after.offset == best[2]
    assert np.allclose(np.exp(after.weight).sum(), 1 - after.stop) and 0 < after.part < lattice.OWN
    # Nothing left out, nothing to fit.
    assert before.fitted(np.zeros(p.size)).part == lattice.OWN
