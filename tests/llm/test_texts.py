"""Fingerprints, line dedup, BPE, packing and URL filters against plain code."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from protospan.llm import bpe, fingerprint, linededup, packing, textops, urlfilter

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n", "a", "Ä ö.\n\nB  c\t d", "x" * 3000, "one two three\n" * 4, "\u2003a\x1cb \x85 c", "don't  stop\n\n\nnow ", "<|endoftext|> end", "日本 語😀"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None, "extra") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None), (101, ODD[6], "en", None, 5, ""), (101, ODD[6], "en", None, 5, ""), (None, "no id here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _line string").repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# Fingerprints

def test_fingerprints_are_multisets(spark):
    rows = spark.createDataFrame([("A b.\nC d.\nE f.", "E f.\nA b.\nC d.", "A b.\nC d.", "E f.", "Q r.\nS t."), ("", "", "", "", "")], "a string, b string, c string, d string, e string")
    v = rows.select(*[fingerprint.vector(F.col(c)).alias(c) for c in "abcde"])
    got = v.select((F.col("a") == F.col("b")).alias("order"), (fingerprint.add(F.col("c"), F.col("d")) == F.col("a")).alias("added"), (fingerprint.subtract(F.col("a"), F.col("d")) == F.col("c")).alias("taken"),
                   fingerprint.likeness(F.col("a"), F.col("c")).alias("near"), fingerprint.likeness(F.col("a"), F.col("e")).alias("far"), (F.col("a") == F.col("e")).alias("alike")).collect()
    assert got[0].order and got[0].added and got[0].taken and got[0].near > 0.5 > got[0].far and not got[0].alike
    assert got[1].near == 1 and got[1].alike


def test_edits(odd):
    got = fingerprint.fingerprint_edits(odd).collect()
    rows = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()])
    want = Counter()
    for k, (known, i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        want[i if known else None, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 12 * 65 for r in got)


@pytest.mark.parametrize("stretch", [1, 7, 10**15])
def test_next_of_scattered_ids(spark, stretch):
    ids = [k * stretch - 5 for k in range(40)]
    docs = spark.createDataFrame([(i, f"t{i}.") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, block=4).collect()}
    assert got == {a: f"t{b}." for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_blocks_of_uneven_ids_are_small(spark):
    rows = [(i, f"t{i}.") for i in range(2000)] + [(2**62, "far."), (-(2**63), "least."), (2**63 - 1, "most.")]
    rows += [(None, f"none {i}.") for i in range(1000)] + [(7, f"again {i}.") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprint.with_next(docs, block=16, ranges=64).collect()
    after = {(r.doc_id, r.text): r.next_text for r in got}
    assert len(after) == len(got) == len(rows) and set(after.values()) == {t for _, t in rows}
    ids = {t: i for i, t in rows}
    for (i, t), u in after.items():
        j = ids[u]
        if t == "most.":
            assert j is None
        elif i is not None:
            assert j >= i and not (i < 2000 and i != 7 and j != i + 1 and i not in (1999, -(2**63)))
    # About 80 rows a range; even one with a far id keeps far less than all rows in a block.
    keyed = docs.select(((F.coalesce(F.col("doc_id"), F.lit(-1)).cast("decimal(20,0)") * F.lit(2**20).cast("decimal(18,0)")) + F.pmod(F.xxhash64("text"), F.lit(2**20))).cast("decimal(38,0)").alias("_key"))
    at, number = fingerprint._blocks(keyed, 16, 64)
    assert keyed.withColumn("_r", at).groupBy(number.alias("b")).count().agg(F.max("count")).first()[0] <= 400


def plain_vector(text):
    """The fingerprint by its definition, with xxhash's own library (Spark's seed is 42)."""
    def h(data, seed=42):
        return xxhash.xxh64(data, seed=seed).intdigest()

    lanes = [0] * (fingerprint.LANES + 1)
    for p in re.split(fingerprint.BREAKS, text or ""):
        if p.strip(" "):
            bits, salt = h(p.encode()), h(p.encode(), h(struct.pack("<i", 1)))
            for i in range(fingerprint.LANES):
                high = h(struct.pack("<i", i), h(struct.pack("<Q", salt))) & 0xFFFFFF
                lanes[i] = (lanes[i] + (high << 24) + (bits >> i & 1)) % 2**48
            lanes[-1] = (lanes[-1] + 1) % 2**48
    return lanes


def plain_likeness(a, b):
    if a == b:
        return 1.0
    s = [np.array([2 * (x & 0xFFFFFF) - v[-1] for x in v[:-1]], float) for v in (a, b)]
    norm = s[0] @ s[0] + s[1] @ s[1]
    return 0.0 if norm == 0 else float(min(1, max(0, 2 * (s[0] @ s[1]) / norm)))


def test_fingerprints_by_definition(spark, none):
    texts = ["A b. C d!\nE f.", None, "E f.\n A b.", "", "é ü? 日本\n\nx", "A b.\n" * 50 + "end", "A b. C d! Q."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    for i, t in enumerate(texts):
        t, u = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        a, b, c = (plain_vector(x) for x in (t, t[: len(t) - half] + u[:half], u))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:012x}" for x in v) for v in (a, b))
        assert r.near_edited == pytest.approx(plain_likeness(a, b)) and r.near_next == pytest.approx(plain_likeness(a, c))
    assert fingerprint.fingerprint_edits(none).count() == 0


# Line dedup

def plain_dedup(docs, min_lines=4, min_words=10):
    seen_line, seen_run, gone = set(), set(), set()
    for i, text in docs:
        lines = text.split("\n")
        for p, line in enumerate(lines):
            if line in seen_line and len(re.split(r"\s+", line.strip(" "))) >= min_words:
                gone.add((i, p))
            seen_line.add(line)
            run = tuple(lines[p : p + min_lines])
            if len(run) == min_lines:
                if run in seen_run:
                    gone |= {(i, p + k) for k in range(min_lines)}
                seen_run.add(run)
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 5])
def test_line_dedup(spark, min_lines):
    rng = random.Random(min_lines)
    lines = ["a", "b c", "", "one two three four five six seven eight nine ten", "d"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in linededup.dedup_lines(table, min_lines).collect()}
    want = plain_dedup(docs, min_lines)
    for i, t in docs:
        assert got[i].text == want[i]
        assert got[i].n_lines == t.count("\n") + 1


def test_line_dedup_of_odd_rows(odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and "_line" in got[0].__fields__
    assert [r.text for r in got if r.doc_id == 100] == [None]
    assert sorted(r.text for r in got if r.doc_id == 101) == ["", ""] and [r.text for r in got if r.doc_id == 6] == [ODD[6]]
    assert linededup.dedup_lines(none).count() == 0


# BPE

@pytest.fixture(scope="module")
def multi():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={}), bpe.tree_encoder(public_tokenizers.PATTERN, open(MULTI, "rb").read())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sreé12,.\x1c\x85\u3000abc")), st.characters(codec="utf-8")), max_size=80))
def test_bpe_is_tiktoken(multi, text):
    assert np.frombuffer(multi[1].many([text])[0], "<u4").tolist() == multi[0].encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"[\s\S]{1,8}", r"\S+|\s+", public_tokenizers.PATTERN])
def test_bpe_by_any_pattern(pattern, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    raw, rng = open(MULTI, "rb").read(), random.Random(3)
    texts = ["".join(rng.choice(["the ", "of", " ", "\n", "é", "xyz", "12", "ing ", "’s "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    ours = bpe.tree_encoder(pattern, raw, 40)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.many(texts)] == [lib.encode_ordinary(t) for t in texts]
    assert len(ours.known) <= 40 and ours.many([None, ""]) == [b"", b""]


def test_trees_of_many_pieces(multi):
    rng, ranks = random.Random(4), bpe.read_ranks(MULTI)
    for most in (2, 3, 9, 40, 200):
        pieces = ["".join(rng.choice("theriané ") for _ in range(rng.randint(1, most))).encode() for _ in range(50)]
        got = [np.frombuffer(x, "<u4").tolist() for x in multi[1].merged(pieces)]
        assert got == [bpe.merge(p, ranks, max(map(len, ranks))) for p in pieces]


def test_bpe_of_long_pieces(multi):
    for text in ("a" * 20_000, "ab" * 5000 + " " * 400 + "x", "\n" * 900, "é" * 3000):
        assert np.frombuffer(multi[1].many([text])[0], "<u4").tolist() == multi[0].encode_ordinary(text)


def test_bpe_tables(odd, none, multi):
    rows = bpe.decode(bpe.encode(odd, MULTI, public_tokenizers.PATTERN), MULTI).collect()
    assert len(rows) == odd.count() and "_line" in rows[0].__fields__
    by_id = {r.doc_id: r for r in rows}
    for i, t in enumerate(ODD):
        assert by_id[i].ids == multi[0].encode_ordinary(t) and bytes(by_id[i].bytes).decode() == t
    assert by_id[100].ids == [] and bytes(by_id[100].bytes) == b""
    assert bpe.encode(none, MULTI, public_tokenizers.PATTERN).count() == 0


# Packing

@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(histogram):
    room, spots = {}, Counter()
    for length, rank0, ranks, seq0, offset, each in packing.plan(histogram, 32):
        for r in range(ranks):
            s, at = seq0 + r // each, offset + r % each * length
            assert room.get(s, 0) == at
            room[s] = at + length
            assert room[s] <= 32
        spots[length] += ranks
        assert rank0 == spots[length] - ranks
    assert dict(spots) == histogram
    bins = []  # one by one: the fullest sequence that holds it
    for length in sorted(Counter(histogram).elements(), reverse=True):
        fit = [(b, k) for k, b in enumerate(bins) if b >= length]
        if fit:
            bins[min(fit)[1]] -= length
        else:
            bins.append(32 - length)
    assert len(room) == len(bins)


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    hf = Tokenizer.from_file(path)
    long = spark.createDataFrame([(200, "word and " * 3000, None, None, None, None)], odd.schema)
    docs = odd.union(long)
    got = packing.packed_digests(docs, path, added=True).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, g in got[got.doc_id.notna() & (got.doc_id != 101)].groupby("doc_id"):
        ids, at = hf.encode(texts[i] or "", add_special_tokens=False).ids + [2], 0
        for r in g.sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (g.sort_values("piece").length.iloc[1:] == 1024).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert len(got[got.doc_id == 101]) == 2 and got.doc_id.isna().sum() == 1
    assert packing.packed_digests(none, path).count() == 0


# URL filters

def plain_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, None, "allow")
    return host, path, best[1], best[2]


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?y#z", "http://a.example.com/de/", "http://example.com/de", "https://x.org/fr/a/b/../c", "http://net", "http://net/", "http://inet/", "http://a..net/",
            "http://u@b.net:80/en/", "http://ÄB.example.net/en/", "x://y://example.net/en/", "http://example.net/en/" + "a/" * 3000, "http://" + "a." * 2000 + "net/", "http://sub.example.net?en/", "http://example.net/en/\nq"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlfilter.judge(pages, urlfilter.rule_table(spark)).collect()}
    assert len(got) == 2 * len(urls)
    for i, u in enumerate(urls * 2):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == plain_verdict(u, urlfilter.RULES)
    empty = urlfilter.judge(pages, urlfilter.rule_table(spark).limit(0)).groupBy("verdict").count().collect()
    assert [(r.verdict, r["count"]) for r in empty] == [("allow", 2 * len(urls))]
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(pages, urlfilter.rule_table(spark, [("a", "/b", "block")]))


# Words

@given(st.lists(st.text(alphabet="aA bé\n\t.", max_size=40), max_size=6), st.integers(3, 60))
@settings(max_examples=200, deadline=None)
def test_words(texts, limit):
    raw = [t.encode() for t in texts]
    got = [(d, bytes(w.bytes[s:e]), h) for w in textops.segments(raw, limit) for d, h, s, e in zip(w.doc, w.hash, w.start, w.end, strict=True)]
    want = [(i, x) for i, t in enumerate(raw) for x in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
    assert [(d, x) for d, x, _ in got] == want
    assert all(int(h) == textops.hash_bytes(x) for _, x, h in got)
