"""Two vocabularies in one session, repeated ids, and extra columns of any name."""

import base64

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from protospan.llm import bpe, langid, linededup, neardup, packing, quality, urlfilter

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = "the and of in to ing er on the 1 2 3"


def ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def other(tmp_path_factory):
    """A rank file of the same length whose single bytes have their ranks in another order."""
    lines = open(MULTI, "rb").read().splitlines()
    singles = [i for i, line in enumerate(lines) if len(base64.b64decode(line.split()[0])) == 1]
    a, b = (next(i for i in singles if base64.b64decode(lines[i].split()[0]) == c) for c in (b"1", b"2"))
    (ta, ra), (tb, rb) = lines[a].split(), lines[b].split()
    lines[a], lines[b] = ta + b" " + rb, tb + b" " + ra
    path = tmp_path_factory.mktemp("ranks") / "other.tiktoken"
    path.write_bytes(b"\n".join(lines) + b"\n")
    assert path.stat().st_size == len(open(MULTI, "rb").read())
    return str(path)


@pytest.mark.parametrize("first", [True, False])
def test_two_rank_files_of_one_length(spark, other, first):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string").coalesce(1)
    for path in (MULTI, other, MULTI) if first else (other, MULTI, other):
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        (row,) = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
        assert row.ids == plain.encode_ordinary(TEXT) and bytes(row.bytes).decode() == TEXT


def test_two_tokenizers_of_one_length(spark, tmp_path):
    raw = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    # Another string for the added token.
    (tmp_path / "b.json").write_text(raw.replace("<|endoftext|>", "<|endofword|>"), encoding="utf-8")
    docs = spark.createDataFrame([(1, "<|endofword|>")], "doc_id long, text string").coalesce(1)
    for path, n in ((public_tokenizers.path("byte_bpe_50k.json"), None), (str(tmp_path / "b.json"), 2)):
        (row,) = packing.pieces(docs, path, added=True).collect()
        assert row.length == n if n else row.length > 2


def test_vectors_that_share_an_id(spark):
    far = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    rows = [(1, far[0]), (1, far[1]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_extra_columns(spark):
    """Dots, other case and the names that operators use inside."""
    names = ["a.b", "IDS", "SCORE", "Rejected", "LANG_PRED", "Predicted", "n_Lines", "_line", "_row", "_url", "_deal", "_hits", "HOST", "_pos", "_t", "bytes"]
    base = spark.createDataFrame([(1, "one two three\nfour", "http://x.net/a"), (2, None, None)], "doc_id long, text string, url string")
    docs = base.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = lambda df, *gone: {n for n in names if n.lower() not in gone} <= set(df.columns) and df.collect()
    assert kept(linededup.dedup_lines(docs), "n_lines", "n_deleted", "n_runs")
    assert kept(urlfilter.judge(docs.withColumnRenamed("doc_id", "page_id"), urlfilter.rule_table(spark)), "host")
    assert kept(bpe.decode(bpe.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI), "ids", "bytes")
    assert kept(langid.predict(docs, langid.train([])), "lang_pred", "score", "rejected")
    assert kept(quality.predict(docs.withColumn("n_chars", F.lit(1)), quality.train([])), "score", "predicted")


def test_one_url_on_many_pages(spark):
    rows = [(i, "http://a.example.net/en/x") for i in range(500)] + [(1000, "http://b.org/fr/"), (1001, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("m", F.create_map(F.lit("a"), "page_id"))
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark)).collect()}
    assert len(got) == 502 and all(got[i] == ("example.net/en/", "allow") for i in range(500)) and got[1000] == ("org/fr/", "allow") and got[1001] == (None, "allow")
