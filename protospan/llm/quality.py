"""Document quality: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: the words it has, hashed, each with the root of its share of all words; and some
twenty numbers on its structure (lengths, shares of kinds of characters, repetition, the length that
the table states against the text's own). Score: w0 + sum w_i x_i + the interactions of all pairs,
sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2) / 2, which takes time linear in the number of features.
Trained by AdaGrad on the logistic loss in numpy, on a bounded sample of labelled rows.

Defined results: null and empty texts are scored by their structure numbers alone. With no labelled
row, or with labels of one kind, every score is the share of label 1 (0.5 if there is none). A document with
several labels counts with each. Texts of any length count whole; equal rows are scored each; an empty table
gives no rows. Other columns are kept, but ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protospan.functions.blocks import mapped
from protospan.llm import textops
from protospan.llm.sample import bounded, remainder
from protospan.llm.store import python_ready

BITS = 15
RANK = 8
#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 6000
THRESHOLD = 0.3

_KIND = np.full(256, 7)  # other bytes: parts of letters beyond ASCII
_KIND[:128] = 6  # symbols and control characters
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(b".,;:'\"()-?")] = 3
_KIND[32], _KIND[10] = 4, 5
STATS = 8 + 9


def stats(texts: list[bytes], stated: list, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Structure numbers of each text, and how far the stated number of characters is off."""
    n = np.array([len(t) for t in texts], float)
    kinds = np.zeros((len(texts), 8))
    lines = np.zeros(len(texts))
    chars = np.zeros(len(texts))
    for i, t in enumerate(texts):
        for at in range(0, len(t), textops.LIMIT):
            b = np.frombuffer(t, np.uint8)[at : at + textops.LIMIT]
            kinds[i] += np.bincount(_KIND[b], minlength=8)
            chars[i] += np.count_nonzero((b & 0xC0) != 0x80)
        lines[i] = t.count(b"\n") + 1
    words = np.bincount(doc, minlength=len(texts)).astype(float)
    first = np.unique(textops.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=len(texts))
    doubled = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
    off = np.array([np.log1p(abs(s - c)) if s is not None else 0.0 for s, c in zip(stated, chars, strict=True)])
    size, count = np.maximum(n, 1), np.maximum(words, 1)
    return np.column_stack([
        kinds / size[:, None], np.log1p(n), np.log1p(words), n / count, np.log1p(n / lines), distinct / count,
        doubled / count, kinds[:, 6] / count, np.log1p(lines), off,
    ])


def features(texts: list[bytes], stated: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of every word feature, and the texts' structure numbers."""
    doc, hashes = textops.word_hashes(texts)
    key, count = np.unique(doc.astype(np.int64) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row = key >> BITS
    total = np.bincount(doc, minlength=len(texts))
    return row, key & (1 << BITS) - 1, np.sqrt(count / total[row]), stats(texts, stated, doc, hashes)


@dataclass
class Model:
    base: float
    weight: np.ndarray  # of buckets, then of structure numbers
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, numbers: np.ndarray) -> np.ndarray:
        return np.clip((numbers - self.mean) / self.spread, -4, 4) / 4

    def margin(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        n, dense = len(numbers), self.scaled(numbers)
        w, v = self.weight[1 << BITS :], self.factors[1 << BITS :]
        out = self.base + dense @ w + np.bincount(row, self.weight[at] * x, n)
        squares = np.bincount(row, (self.factors[at] ** 2).sum(axis=1) * x * x, n) + dense**2 @ (v**2).sum(axis=1)
        sums = np.stack([np.bincount(row, self.factors[at, f] * x, n) for f in range(RANK)], axis=1) + dense @ v
        return out + ((sums**2).sum(axis=1) - squares) / 2

    def scores(self, *given: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*given), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 15, rate: float = 0.2, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fit on (buckets, values, structure numbers, label) of each row."""
    size = (1 << BITS) + STATS
    rng = np.random.default_rng(seed)
    label = np.array([r[3] for r in rows], float)
    share = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.5
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), np.zeros(STATS), np.ones(STATS))
    if len(set(label.tolist())) < 2:
        model.factors[:] = 0
        return model
    numbers = np.stack([r[2] for r in rows])
    model.mean, model.spread = numbers.mean(axis=0), numbers.std(axis=0) + 1e-6
    dense = model.scaled(numbers)
    gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    columns = np.arange(1 << BITS, size)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            lens = [len(rows[i][0]) + STATS for i in batch]
            at = np.concatenate([np.concatenate([rows[i][0], columns]) for i in batch]).astype(np.int64)
            x = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in batch])
            row = np.repeat(np.arange(len(batch)), lens)
            f = model.factors[at]
            sums = np.stack([np.bincount(row, f[:, k] * x, len(batch)) for k in range(RANK)], axis=1)
            z = model.base + np.bincount(row, model.weight[at] * x + 0.0, len(batch))
            z += ((sums**2).sum(axis=1) - np.bincount(row, (f**2).sum(axis=1) * x * x, len(batch))) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) / len(batch)
            slope = g[row] * x
            uniq, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, slope, len(uniq)) + decay * model.weight[uniq]
            dv = np.stack([np.bincount(inverse, slope * (sums[row, k] - f[:, k] * x), len(uniq)) for k in range(RANK)], axis=1) + decay * model.factors[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            gb += g.sum() ** 2
            model.weight[uniq] -= rate * dw / np.sqrt(gw[uniq])
            model.factors[uniq] -= rate / 4 * dv / np.sqrt(gv[uniq])
            model.base -= rate * g.sum() / np.sqrt(gb)
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) modulo 5 is not 0, at most ``most`` labels."""
    python_ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = bounded(known.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)), "doc_id", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                row, at, x, numbers = features(textops.encoded(b.column("text")), b.column("n_chars").to_pylist())
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("quality")] + [pa.array([a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for a in (at.astype("<u2"), x)]
                    + [pa.array([r.tobytes() for r in numbers], pa.binary())],
                    names=["doc_id", "quality", "at", "x", "numbers"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(known), "doc_id")
    found = rows.select("doc_id", "quality", "text", "n_chars").mapInArrow(run, "doc_id long, quality int, at binary, x binary, numbers binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.quality, r.at, r.numbers))
    return train([(np.frombuffer(r.at, "<u2"), np.frombuffer(r.x), np.frombuffer(r.numbers), r.quality) for r in found])


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    python_ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                score = sent.value.scores(*features(textops.encoded(b.column("text")), b.column("n_chars").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(f.name) for f in kept] + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                    names=[f.name for f in kept] + ["score", "predicted"],
                )

    return mapped(docs, run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
