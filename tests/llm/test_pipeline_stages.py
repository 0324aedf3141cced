"""Every stage of the pipeline against plain code on its own input, and the language model in plain code."""

import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from protospan.llm import langid, packing, quality

TABLES = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Some given documents, with near copies, repeated runs of lines and odd rows among them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select(corpus_pipeline.COLUMNS).orderBy("doc_id").limit(120).collect()]
    rng, more = random.Random(4), []
    for k, r in enumerate(rows[:12]):
        words = (r[1] or "").split(" ")
        if len(words) > 60:
            more.append((10_000 + k, " ".join([*words[:-1], "other"]), r[2], r[3], 1))
    run = "\n".join(f"a line {i} that comes again" for i in range(5))
    more += [(20_000 + k, f"{rows[40 + k][1]}\n{run}\nown {rng.random()}", "en", "s", 2) for k in range(4)] + [(30_000, None, "en", "s", 0), (30_001, "", None, None, None), (30_002, "12 34", "en", "s", 3), rows[0]]
    table = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(str(tmp_path_factory.mktemp("stages") / "documents.parquet"))
    return table.persist()


def softmax_scores(m, text):
    """The mean over a text's hashed 3- and 4-byte pieces of their embeddings' share, a softmax at the model's temperature."""
    x = [32 if c in b"\t\n\x0b\x0c\r " else c + 32 * (65 <= c <= 90) for c in text.encode()] + [32] * 3
    z, n, word = np.zeros(len(m.langs)), 0, 0xFFFFFFFF
    for i in range(len(x) - 3):
        three = x[i] | x[i + 1] << 8 | x[i + 2] << 16
        four = three ^ x[i + 3] << 24 ^ 0x5BD1E995
        for h in (three * 0x9E3779B1 & word, (four ^ four >> 15) * 0x85EBCA6B & word):
            z += m.table[h >> 32 - langid.BITS]
            n += 1
    e = np.exp((z / n + m.bias) / m.temperature - ((z / n + m.bias) / m.temperature).max())
    return e / e.sum()


def test_language_id(spark, docs):
    m = langid.learn(docs)
    rows = langid.predict(docs, m).collect()
    for r in rows:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == (langid.UNKNOWN, 0.0, True)
            continue
        p = softmax_scores(m, r.text)
        assert r.lang_pred == m.langs[int(np.argmax(p))] and r.score == pytest.approx(max(p), abs=1e-9) and r.rejected == (r.score < m.least)
    kept = corpus_pipeline.language_id(spark, docs, TABLES)
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(tuple(r)[:5]) for r in rows if not r.rejected)


def test_quality_classifier(spark, docs):
    m = quality.learn(docs, spark.read.parquet(f"{TABLES}/labels.parquet"))
    want = []
    for r in docs.collect():
        # Pairwise products one by one, instead of by sums of squares.
        _, at, x, numbers = quality.features([(r.text or "").encode()], [r.n_chars])
        at, x = [*at.tolist(), *range(1 << quality.BITS, (1 << quality.BITS) + quality.STATS)], [*x.tolist(), *m.scaled(numbers)[0].tolist()]
        z = m.base + sum(m.weight[a] * v for a, v in zip(at, x, strict=True))
        f = m.factors[at] * np.array(x)[:, None]
        z += np.triu(f @ f.T, 1).sum()
        if 1 / (1 + math.exp(-max(-30, min(30, z)))) >= quality.THRESHOLD:
            want.append(str(tuple(r)))
    got = corpus_pipeline.quality_classifier(spark, docs, TABLES)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want) and 0 < len(want) < docs.count()


def plain_line_dedup(rows):
    """Windows of four lines and long lines stay in their earliest copy."""
    lines = {}
    for i, t in {(r[0], r[1]) for r in rows if r[1] is not None}:
        lines[i, t] = t.split("\n")
    gone, seen4, seen1 = {}, {}, {}
    for key in sorted(lines):
        own = lines[key]
        for k in range(len(own)):
            if len(own[k].strip(" ").split()) >= 10 and seen1.setdefault(own[k], (key, k)) != (key, k):
                gone.setdefault(key, set()).add(k)
            if k + 4 <= len(own) and seen4.setdefault(tuple(own[k : k + 4]), (key, k)) != (key, k):
                gone.setdefault(key, set()).update(range(k, k + 4))
    out = []
    for r in rows:
        cut = gone.get((r[0], r[1]), ())
        text = r[1] if not cut else "\n".join(x for k, x in enumerate(lines[r[0], r[1]]) if k not in cut)
        if not cut or text.strip(" "):
            out.append((r[0], text, r[2], r[3], len(text) if cut else r[4]))
    return out


def test_line_dedup(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in corpus_pipeline.line_dedup(spark, docs, TABLES).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_line_dedup(rows)))
    assert any("a line 3" in r[1] for r in got if r[1]) and len(got) < len(rows)


def test_ngram_jaccard(spark, docs):
    rows = sorted({tuple(r) for r in docs.collect()}, key=str)
    grams = []
    for r in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda c: c[0].lower(), r[1] or ""))
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = {i: {j for j in range(len(rows)) if i != j and grams[i] and grams[j] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])} for i in range(len(rows))}
    want, seen = [], set()
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if i not in seen:
            want.append(rows[i])
            stack = [i]
            while stack:
                a = stack.pop()
                if a not in seen:
                    seen.add(a)
                    stack += near[a]
    got = corpus_pipeline.ngram_jaccard(spark, docs, TABLES)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want)) and len(want) < len(rows)


def test_best_fit_packing(spark, docs):
    rows = corpus_pipeline.best_fit_packing(spark, docs, TABLES).collect()
    plain, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d in docs.collect():
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, packing.END]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0, *(n for _, n in p)])[:-1]) and sum(n for _, n in p) <= 1024
    # Best fit of the same lengths, piece by piece.
    room = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = min((x for x in room if x >= n), default=None)
        room.append((1024 if fit is None else room.pop(room.index(fit))) - n)
    assert len(places) == len(room)


def test_stages_run_in_order(spark, docs, tmp_path):
    (tmp_path / "labels.parquet").symlink_to(Path(TABLES) / "labels.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), schema=stage(spark, step, str(tmp_path)).schema)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(str(tuple(r[c] for c in key)) for r in step.collect()) == sorted(str(tuple(r[c] for c in key)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
