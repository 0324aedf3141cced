"""Language, quality and lattice scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from protospan.llm import langid, lattice, quality, textops
from protospan.llm.sample import bounded

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": "the of and with that this from have which".split(), "de": "der die und nicht über mit sich auch wird".split(), "fr": "le la des être avec pour dans été nous".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(4), []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 40)))
        if i % 7 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, lang, "s", len(text)))
    rows += [(1000, None, "en", None, None), (1001, "", "en", None, 0), (1002, "123 ... 456", None, None, 11), (1003, "the of " * 60_000, None, None, 5), (None, "the and", "en", None, 7), (5, rows[5][1], "fr", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_language(docs, none):
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == docs.count() and "source" in got[0].__fields__
    held = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(none, langid.learn(none)).count() == 0
    unlearned = langid.predict(docs, langid.learn(none)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and {r.doc_id for r in unlearned if r.rejected} == {1000, 1001, 1002}


def test_samples_keep_to_their_bound(spark):
    rows = spark.createDataFrame([(7, f"t{i % 40}") for i in range(400)] + [(i, "x") for i in range(5)], "doc_id long, text string")
    for most in (1, 10, 300, 500):
        assert bounded(rows, "doc_id", most).count() == min(most, 405)


def test_language_sums_are_means_of_whole_texts():
    table = np.random.default_rng(0).normal(size=(1 << langid.BITS, 3))
    texts = [b"", b"a", b"Some text here", ("é ü\n" * 400_000).encode(), b"x" * 17]
    for t, row in zip(texts, langid.text_sums(texts, table), strict=True):
        at, share = langid.features(t)
        assert np.allclose(row, share @ table[at] if len(at) else 0)


def test_language_learns_the_same_on_any_partitioning(docs):
    a, b = langid.learn(docs), langid.learn(docs.repartition(2))
    assert np.array_equal(a.table, b.table) and a.least == b.least


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 0 if i % 7 == 0 else 1, 0) for i in range(240)] + [(1000, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(docs, quality.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 7 != 0) for r in held) >= 0.95 * len(held)
    assert quality.predict(none, quality.learn(none, labels)).count() == 0
    plain = quality.predict(docs, quality.learn(docs, labels.limit(0))).collect()
    assert {r.score for r in plain} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = quality.Model(0.3, rng.normal(size=(1 << quality.BITS) + quality.STATS), rng.normal(size=((1 << quality.BITS) + quality.STATS, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    row, at, x, numbers = quality.features([b"some words and some more", b""], [3, None])
    got = m.margin(row, at, x, numbers)
    for d in range(2):
        i = np.append(at[row == d], np.arange(1 << quality.BITS, len(m.weight))).astype(int)
        v = np.append(x[row == d], m.scaled(numbers)[d])
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert got[d] == pytest.approx(0.3 + m.weight[i] @ v + pairs)


def plain_word(word, p):
    def paths(at):
        if at == len(word):
            return 1.0
        total = math.exp(p.weight[p.byte[word[at]]]) * paths(at + 1)
        return total + sum(math.exp(p.weight[p.inner[word[at:e]]]) * paths(e) for e in range(at + 1, len(word) + 1) if word[at:e] in p.inner)

    whole = math.exp(p.weight[p.mark]) * paths(0)
    whole += sum(math.exp(p.weight[p.first[word[:e]]]) * paths(e) for e in range(1, len(word) + 1) if word[:e] in p.first)
    return math.log10(whole * p.stop / (1 - p.stop))


def test_lattice_sums_all_paths():
    p = lattice.read_pieces(PIECES)
    words = [b"the", b"a", "été".encode(), b"thestran", b"\xff\x00q", b"zzzzzz"]
    expected, thrice = np.zeros(p.size), np.zeros(p.size)
    (w,) = textops.segments(words)
    lattice.forward(w, np.arange(len(words)), p, thrice, np.full(len(words), 3))
    assert np.allclose(lattice.forward(w, np.arange(len(words)), p, expected), [plain_word(x, p) for x in words])
    assert np.allclose(thrice, 3 * expected)
    # Every byte lies in one piece of each path.
    assert expected.sum() >= len(words) and lattice._long_word(b"thestran", p) / math.log(10) + math.log10(p.stop / (1 - p.stop)) == pytest.approx(plain_word(b"thestran", p))
    assert np.exp(p.weight).sum() == pytest.approx(1 - p.stop)


@pytest.mark.parametrize("most", [1 << 20, 8, 0])
def test_lattice_scores(docs, none, most, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_SENT", most)
    got = lattice.score(docs, PIECES).collect()
    tokens = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    rows = docs.collect()
    crc = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10
    c = Counter(t for r in rows if crc(r) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id, crc(r) == 0, len(t), sum(x in c for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    # A document's score is the sum over all paths through each of its words, in turn.
    pieces, ends = lattice.learn(docs, PIECES)[0].pieces, c[None]
    last, word = (ends / n if ends else lattice.END), {}
    want = Counter()
    for r in rows:
        if sum(map(len, tokens(r.text)[:-1])) < 200:
            for x in tokens(r.text)[:-1]:
                word[x] = word[x] if x in word else plain_word(x.encode(), pieces) + math.log10(1 - last)
            want[r.doc_id, round(sum(word[x] for x in tokens(r.text)[:-1]) + math.log10(last), 4)] += 1
    assert len(want) > 20 and not want - Counter((r.doc_id, round(r.score, 4)) for r in got)
    if most:
        assert lattice.score(none, PIECES).count() == 0
