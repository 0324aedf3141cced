"""Near-duplicate joins, components and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

from protospan.llm import components, neardup, ngramjoin


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"path": [(i, i + 1) for i in range(70)], "star": [(99, i) for i in range(60)], "random": [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)], "none": [(3, 3)]}[shape]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == closure(nodes, [(a, b) for a, b in links if a != b])


def test_components_of_stars_take_one_look(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda *a, keep=components.materialize: written.append(1) or keep(*a))
    stars = spark.createDataFrame([(i % 3, i) for i in range(3, 60)], "a long, b long")
    assert {r.node: r.component for r in components.components(stars).collect()} == {i: i % 3 for i in range(60)}
    assert len(written) == 1  # no round over what is settled already


def test_no_pairs_no_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(ngramjoin, "_that", lambda *a, keep=ngramjoin._that: passes.append(1) or keep(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(12)] + [(20, None), (None, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_classes(docs).collect()}
    assert got == {i: i for i in [*range(12), 20, None]} and not passes


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    rows = [(i, (hot + 0.05 * rng.normal(size=16)).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=16).tolist()) for i in range(100)]
    rows += [(300 + i, rows[60 + i][1]) for i in range(20)] + [(400, [2 * x for x in rows[60][1]])]
    bad = [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] + [1.0] * 15), (505, [float("inf")] * 16), (506, [1.0, 2.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = {r.vec_id: r for r in neardup.near_vectors(table).collect()}
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = closure(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    assert sum(got[i].n_links for i in ids) >= 0.97 * near.sum()
    for k, i in enumerate(ids):
        assert got[i].n_links <= near[k].sum() and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    for i, _ in bad:
        assert got[i].n_links == 0 and got[i].component_id == i
    assert neardup.near_vectors(table.limit(0)).count() == 0


def sets_of(docs, words):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def compare_classes(spark, words, least):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy) + (" " + shared if i % 3 == 0 else "")))
    docs += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "One"), (905, "one two"), (906, docs[0][1].upper())]
    sets = sets_of(docs, words)
    links = [(a, b) for a in sets for b in sets if a < b and (o := len(sets[a] & sets[b])) and 100 * o >= least * len(sets[a] | sets[b])]
    want = closure(sets, links)
    table = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, "no id", "z")], "doc_id long, text string, rep string").repartition(5)
    got = {r.doc_id: r for r in ngramjoin.ngram_classes(table, words, least).collect()}
    assert len(links) > 15 and len(got) == len(docs) + 1 and got[None].component_id is None
    for i, _ in docs:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), want[i])
    assert ngramjoin.ngram_classes(table.limit(0), words, least).count() == 0


@pytest.mark.parametrize(("words", "least"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_classes(spark, words, least):
    compare_classes(spark, words, least)


def test_ngram_classes_with_shuffled_ids_and_few_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "MOST_IDS", 0)
    monkeypatch.setattr(ngramjoin, "MOST_SENT", 3)
    compare_classes(spark, 4, 85)


def test_ngram_classes_with_hot_ngrams_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HOT", 2)
    monkeypatch.setattr(ngramjoin, "SPREAD", -1)
    monkeypatch.setattr(ngramjoin, "PIVOTS", 2)
    compare_classes(spark, 4, 85)


@pytest.mark.parametrize("least", [70, 85])
def test_parities_never_hide_a_link(least):
    rng = np.random.default_rng(least)
    for n in (1, 2, 5, 40, 700):
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.unique(np.concatenate([a[rng.random(n) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 9)).astype(np.uint64)]))
            a = np.unique(a)
            if ngramjoin._links(a.tobytes(), b.tobytes(), least, 100):
                assert ngramjoin._may_link(ngramjoin._parity(a), ngramjoin._parity(b), least, 100)
    x, y = (rng.integers(0, 1 << 63, 700).astype(np.uint64) for _ in range(2))
    assert not ngramjoin._may_link(ngramjoin._parity(x), ngramjoin._parity(y), least, 100)


def test_ngram_classes_of_near_copies_and_repeated_ids(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    docs = []
    for i in range(70):  # one group in which not all are alike
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(80)] = f"v{rng.randint(0, 400)}"
        docs.append((i, " ".join(copy)))
    others = [(7, "quite another text under an id that is there already once more"), (8, "and a third one of that kind with words of its own in it")]
    sets = {k: s for k, (_, s) in zip([*docs, *others], [(d[0], sets_of([d], 5)[d[0]]) for d in [*docs, *others]], strict=True)}
    rows = sorted(sets)
    links = [(a, b) for a in rows for b in rows if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(rows, links)
    table = spark.createDataFrame([*docs, *others, docs[3]], "doc_id long, text string").repartition(4)
    got = ngramjoin.ngram_classes(table, 5, 80).join(table.selectExpr("doc_id", "xxhash64(text) t", "text").distinct(), ["doc_id", "t"]).collect()
    assert len(got) == len(docs) + 3
    for r in got:
        root = want[r.doc_id, r.text]
        assert (r.component_id, r.first) == (root[0], root == (r.doc_id, r.text))


def test_ngram_classes_of_a_large_group_among_many_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(240)]
    docs = []
    for _ in range(160):  # most pairs are not alike enough, but links join nearly all
        copy = list(base)
        for _ in range(rng.randint(2, 4)):
            copy[rng.randrange(240)] = f"v{rng.randint(0, 4000)}"
        docs.append((len(docs), " ".join(copy)))
    for k in range(250):
        one = " ".join(f"u{k}x{j}" for j in range(1600))
        docs += [(len(docs), one), (len(docs) + 1, one.replace(f"u{k}x7 ", "z "))]
    tried, that = [], ngramjoin._that

    def counted(docs, pairs, words, made, holds):
        tried.append(pairs.count())
        return that(docs, pairs, words, made, holds)

    monkeypatch.setattr(ngramjoin, "_that", counted)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_classes(table, 4, 85).collect()}
    sets = sets_of(docs, 4)
    near = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert 160 < len(near) < 160 * 159 / 4
    assert got == closure(sets, [*near, *((k, k + 1) for k in range(160, 660, 2))])
    # The last but one: pairs across components.
    assert tried[-2] < 160 * 10


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(8)
    en, de = "the of and with that this from have which".split(), "der die und nicht über mit sich auch wird".split()
    rows = []
    for i in range(150):
        text = "\n".join(" ".join(rng.choice(de if i % 3 == 0 else en) for _ in range(12)) + "." for _ in range(5))
        rows.append((i, text if i % 5 else text.upper().replace(" ", "%%% "), "de" if i % 3 == 0 else "en", "s", len(text)))
    rows += [(200, "123", None, None, 3), (201, rows[1][1], "en", "s", 9), (202, " ".join(rows[2][1].split()), "en", "s", 9), (203, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == c.COLUMNS
    assert not {200, 203} & left[0] and {201, 202} <= left[0]
    assert len([i for i in left[1] if i % 5 == 0 and i < 150]) <= 3 and len([i for i in left[1] if i % 5]) >= 118
    assert 201 not in left[2] and 202 in left[2] and 202 not in left[3]
    assert left[4] == left[3]
    assert c.run(spark, str(tmp_path)).count() == docs.count()
    # Empty tables, repeated rows, and one id with two texts.
    schema, same = spark.read.parquet(f"{tmp_path}/documents.parquet").schema, (5, "one two three four five six seven", None, None, 3)
    for _, stage in c.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    some = spark.createDataFrame([same, same, (5, "another text of its own altogether, it says", None, None, None), (None, same[1], None, None, None), (6, None, None, None, None)], schema)
    assert sorted((r.doc_id or -1, r.text or "") for r in c.ngram_jaccard(spark, some, str(tmp_path)).collect()) == [(-1, same[1]), (5, "another text of its own altogether, it says"), (5, same[1]), (6, "")]
    assert c.best_fit_packing(spark, some, str(tmp_path)).count() == 5
