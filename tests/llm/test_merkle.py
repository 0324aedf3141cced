"""The Merkle manifest against plain code."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from protospan.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes, fanout):
    """Root, and for each leaf the siblings before and after it, level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for i, p in enumerate(at):
            run = runs[p // fanout]
            proofs[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        at, level = [p // fanout for p in at], [h(*r) for r in runs]
    return level[0], proofs


def fold(value, proof):
    for before, after in proof:
        value = h(before, value, after)
    return value


def brute(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    trees = {s: grown([x[2] for x in groups[s]], fanout) for s in names}
    root, tops = grown([trees[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, more in zip(names, tops, strict=True):
        for (_, i, own, r), proof in zip(groups[s], trees[s][1], strict=True):
            proof = proof + more
            odd = zlib.crc32(("" if i is None else str(i)).encode()) % 2
            changed = own if odd or r[4] is None else leaf((*r[:4], r[4].replace("\n", "")))
            got = fold(changed, proof)
            out.append((i, own, trees[s][0], root, h(*(a + b for a, b in proof)), got, got == root))
    return out


def table(spark, rows):
    extra = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, source string, lang string, n_chars long, text string, _g string, `a.b` int, PROOF int").repartition(3)


def given(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()]


def same(got, rows):
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    sizes = {"hot": 200, None: 5, "": 1, "a": 3, "b": 4, "Z": 9, "é": 10, "\U0001f600": 2, "￿": 1, "zz": 28}
    sizes |= {f"s{k}": 1 for k in range(8)}
    ids = iter(rng.sample(range(-500, 2000), 400))
    rows = [(next(ids), s, rng.choice([None, "en", "de"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "c", "\n", "ü\n\n" * 40])) for s, n in sizes.items() for _ in range(n)]
    # Null and repeated ids, equal rows, a very long text.
    rows += [(None, "hot", "en", 1, "x\ny"), (None, "hot", "en", 1, "x\ny"), rows[0], rows[0], (rows[1][0], "hot", "de", 2, "other"), (5000, "b", None, None, "long\n" * 200_000)]
    same(given(spark, tmp_path, rows), rows)


def test_few_rows(spark, tmp_path):
    for k, rows in enumerate([[(7, None, None, None, None)], [(7, "a", "en", 1, "x\n"), (8, "b", "en", 1, "y\n")], [(i, "a", "en", 1, "t\n") for i in range(3)]]):
        same(given(spark, tmp_path / str(k), rows), rows)
    assert given(spark, tmp_path / "none", []) == []


def test_other_fanout(spark):
    rows = [(i, "ab"[i % 2], None, None, str(i)) for i in range(40)]
    df = merkle.manifest(table(spark, rows), merkle.leaf_of([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]), "source", "doc_id", fanout=5)
    want = {r[0]: (r[2], r[3]) for r in brute(rows, 5)}
    for r in df.collect():
        assert want[r.doc_id] == (r.subroot, r.root) and fold(r.leaf, [(s.before, s.after) for s in r.proof]) == r.root
