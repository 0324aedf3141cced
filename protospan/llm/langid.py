"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte 3- and 4-grams (A-Z lowered, white space as blanks), hashed into a table
of embeddings; their average over the whole text goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy on a bounded sample. One fifth of the sample is held back to fit the
softmax's temperature, so that scores are probabilities, and the least score at which a prediction is
kept: the lowest one that leaves at most ``error`` wrong among those kept, but no lower than the OUTLYING
quantile of the scores of held-back rows that are right. So text unlike all learned languages (another
language, encoded bytes, tables of numbers) is rejected even if no held-back row is wrong. With one
language all scores are 1, and fewer than five labelled rows leave none to calibrate on: neither rejects.

Because softmax inputs are linear in the average, tasks only carry each bucket's contribution to each
language, and a prediction is a mean of table rows over all byte positions.

Defined results: null and empty text and text without a letter have ``und`` with score 0 and are rejected. If no
labelled row could be learned from, every text has ``und`` with score 0, but text with a letter is not rejected.
Texts of any length count whole; equal rows are predicted each; an empty table gives no rows. Other columns are
kept, but ``lang_pred``, ``score`` and ``rejected`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protospan.functions.blocks import mapped
from protospan.llm import textops
from protospan.llm.sample import bounded, remainder
from protospan.llm.store import python_ready

BITS = 16
DIM = 16
#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 2000
#: Share of right held-back rows whose scores lie below the cut, at most.
OUTLYING = 0.005
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANKS = textops.LOWER.copy()
_BLANKS[list(textops.SPACES)] = 32


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: each bucket's share of the softmax input
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, sums: np.ndarray) -> np.ndarray:
        z = (sums + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def grams(b: np.ndarray) -> np.ndarray:
    """Bucket of the 3-gram and of the 4-gram that starts at each byte, two columns; three bytes past the end count as blanks."""
    x = np.concatenate([_BLANKS[b], np.full(3, 32, np.uint8)]).astype(np.uint32)
    three = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
    four = three ^ (x[3:] << np.uint32(24)) ^ np.uint32(0x5BD1E995)
    shift = np.uint32(32 - BITS)
    return np.stack([three * np.uint32(0x9E3779B1) >> shift, (four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> shift], axis=1)


def _blocks(text: bytes) -> Iterator[np.ndarray]:
    """A text's bytes, some at a time; neighbours share three bytes, so that every gram is seen once."""
    b = np.frombuffer(text, np.uint8)
    for at in range(0, len(b), textops.LIMIT):
        yield b[at : at + textops.LIMIT + 3]


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how many of a text's grams fall into each."""
    counts = np.zeros(1 << BITS, np.int64)
    for k, b in enumerate(_blocks(text)):
        g = grams(b)[: textops.LIMIT]
        counts += np.bincount(g.ravel(), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / max(1, counts.sum())


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of all of a text's grams."""
    at, counts = counted(text)
    return at, shares(counts)


def text_sums(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Mean table row over all grams of each text; short texts are laid end to end, with blanks between."""
    out = np.zeros((len(texts), table.shape[1]))
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            g = grams(np.frombuffer(b"    ".join(texts[i] for i in group), np.uint8))
            rows = table[g[:, 0]]
            rows += table[g[:, 1]]
            n = np.array([len(texts[i]) for i in group])
            start = np.cumsum(n + 4) - n - 4
            edges = np.stack([start, start + n], axis=1).ravel()
            sums = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]))]), edges, axis=0)[::2]
            out[group] = sums / (2 * n[:, None])
        group, size = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > textops.LIMIT:
            for b in _blocks(t):
                g = grams(b)[: textops.LIMIT]
                out[i] += table[g[:, 0]].sum(axis=0) + table[g[:, 1]].sum(axis=0)
            out[i] /= 2 * len(t)
            continue
        if size + len(t) > textops.LIMIT // 2:
            flush()
        group.append(i)
        size += len(t) + 4
    flush()
    return out


def train(sample: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 2.0, error: float = 0.01, seed: int = 7) -> Model:
    """Fit on (buckets, shares, language) of each row, in any order of the sample's rows that is the same each time."""
    langs = sorted({x[2] for x in sample})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    emb, head, bias = rng.normal(0, 1, (1 << BITS, DIM)) / DIM, np.zeros((DIM, len(langs))), np.zeros(len(langs))
    label = np.array([langs.index(x[2]) for x in sample])
    order = rng.permutation(len(sample))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            at = np.concatenate([sample[i][0] for i in batch])
            share = np.concatenate([sample[i][1] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(sample[i][0]) for i in batch])
            x = np.stack([np.bincount(row, share * emb[at, d], len(batch)) for d in range(DIM)], axis=1)
            z = x @ head + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(batch)), label[batch]] -= 1
            back = g @ head.T
            head -= step * x.T @ g / len(batch)
            bias -= step * g.mean(axis=0) / 40
            for d in range(DIM):
                emb[:, d] -= 8 * step / len(batch) * np.bincount(at, share * back[row, d], 1 << BITS)
    model = Model(langs, emb @ head, bias, 1.0, 0.0)
    if not len(held):
        return model
    z = np.stack([sample[i][1] @ model.table[sample[i][0]] for i in held])
    loss = {}
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = float(t)
        p = np.clip(model.scores(z)[np.arange(len(held)), label[held]], 1e-9, 1 - 1e-9)
        # The target is short of 1, or rows that are all right would call for endless scores.
        sure = (len(held) + 1) / (len(held) + 2)
        loss[model.temperature] = -(sure * np.log(p) + (1 - sure) * np.log(1 - p)).mean()
    model.temperature = min(loss, key=loss.get)
    p = model.scores(z)
    best, right = p.max(axis=1), p.argmax(axis=1) == label[held]
    down = np.argsort(-best)
    wrong = np.cumsum(~right[down]) / np.arange(1, len(down) + 1)
    kept = np.flatnonzero(wrong <= error)
    if not len(kept):
        model.least = 1.0
        return model
    # All held rows may stay by their errors alone: then only the scores of right ones set the cut.
    fair = 0.0 if kept[-1] == len(down) - 1 else float(best[down[kept[-1]]])
    model.least = max(fair, float(np.quantile(best[right], OUTLYING, method="lower")))
    return model


def learn(docs: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fit on rows with a language whose crc32(doc_id) modulo 4 is not 2, at most ``most`` of them."""
    python_ready(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in textops.encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<u4").tobytes() for _, b in found], pa.binary())],
                names=["doc_id", "lang", "at", "n"],
            )

    sample = bounded(rows.select(F.col("doc_id").cast("long"), "lang", "text"), "doc_id", most)
    # Six bytes for each bucket of a text: the driver holds them in its JVM and in Python.
    found = sample.mapInArrow(run, "doc_id long, lang string, at binary, n binary").collect()
    found.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.at, r.n))
    return train([(np.frombuffer(r.at, "<u2"), shares(np.frombuffer(r.n, "<u4")), r.lang) for r in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    python_ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema if f.name.lower() not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                plain = b.column("text").to_pylist()
                letters = np.array([bool(t and _LETTER.search(t)) for t in plain])
                known = letters & bool(m.langs)
                if m.langs:
                    p = m.scores(text_sums([t.encode("utf-8", "surrogatepass") if t else b"" for t in plain], m.table))
                    best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
                else:
                    best, score = np.zeros(len(plain), int), np.zeros(len(plain))
                lang = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~letters | (known & (score < m.least)))],
                    names=[f.name for f in kept] + list(added),
                )

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return mapped(docs, run, schema)
