"""Language-model scores of documents by the marginal likelihood of subword lattices.

A text is a sequence of tokens: words (A-Z lowered), then one end. A word is the blank mark and a path
of pieces of an existing vocabulary through its bytes. The probability of a word is the sum over all
paths, by forward recursion in log space; bytes without a piece take byte arcs, so that nothing has
probability zero.

Weights. The vocabulary's own scores order its pieces; a piece's own weight falls as 1 / (offset + place). A part
of every weight stays that; the rest is the piece's share of the expected counts over the words of the training rows,
each as often as it occurs, from ROUNDS rounds of expectation-maximisation. All rounds but the last leave one in
HELD_BACK occurrences of a word out; the part and the offset are those that make these likeliest. How often a word
goes on after a piece, and a text after a token, is what the training rows have on average.

The base counts whole words and has no part in the model's score. Counts cover all training rows and are
joined by the word's hash. The most frequent words, at most MOST_SENT of them, are sent to every task; for
all other words documents send (word, occurrences) to a join with the counts, so that nothing depends on
the vocabulary fitting in memory.

Defined results: null and empty texts have the end alone. Texts and words of any length count whole. Without
training rows counts are 0 and all weights are the vocabulary's own. Rows that repeat a doc_id, and equal
rows, are scored each. An empty table gives no rows. Other columns of ``docs`` are not used.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.llm import textops
from protospan.llm.bpe import made
from protospan.llm.sample import remainder
from protospan.llm.store import materialize, python_ready

MARK = "▁"
#: Words whose counts every task gets, at most (16 bytes each).
MOST_SENT = 1 << 20
#: Bytes of words that a task holds before it counts them, about.
MOST_BYTES = 1 << 24
#: Share of a piece's weight that is the vocabulary's own, and the offset of places, before they are fitted; offsets tried.
OWN, OFFSET, OFFSETS = 0.5, 10.0, (1.0, 10.0, 100.0, 1000.0, 10_000.0)
#: One occurrence in so many is left out of the counts that the share is fitted to.
HELD_BACK = 8
#: Probability that a word ends after a piece, and that a token is the text's end, before anything is learned.
STOP, END = 0.4, 0.01
#: Longer words go together with words of about their length, WINDOW places at a time.
LONG = 48
WINDOW = 64
ROUNDS = 3
END_KEY = 0x7FFFFFFFFFFFFFFF
_NONE = -np.inf


@dataclass
class Pieces:
    """A vocabulary's pieces inside words, at their start (after the mark), the mark alone and bytes."""

    inner: dict[bytes, int]
    first: dict[bytes, int]
    mark: int
    byte: np.ndarray
    size: int
    place: np.ndarray  # in the order of the vocabulary's scores; infinite without one
    weight: np.ndarray  # natural logarithms of the present ones, less the chance to go on
    share: np.ndarray  # of expected counts
    stop: float = STOP
    part: float = OWN  # of weights that is the vocabulary's own
    offset: float = OFFSET

    def __post_init__(self) -> None:
        self.longest = max(map(len, [b"", *self.inner, *self.first]))
        self.tables = [self._table(x) for x in (self.inner, self.first)]

    @staticmethod
    def _table(found: dict[bytes, int]):
        keys = np.array([textops.hash_bytes(k) for k in found], np.uint64)
        ids = np.array(list(found.values()), np.int64)
        order = np.argsort(keys)
        near = np.zeros(1 << 20, bool)
        near[(keys >> np.uint64(44)).astype(np.int64)] = True
        return keys[order], ids[order], near

    def find(self, hashes: np.ndarray, table: int) -> np.ndarray:
        """Piece of each hash, or -1."""
        keys, ids, near = self.tables[table]
        out = np.full(hashes.shape, -1, np.int64)
        if len(keys):
            hit = np.nonzero(near[(hashes >> np.uint64(44)).astype(np.int64)])
            h = hashes[hit]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[hit] = np.where(keys[at] == h, ids[at], -1)
        return out

    def with_counts(self, expected: np.ndarray, words: float) -> Pieces:
        """Weights from expected counts over so many words, and the vocabulary's own."""
        total = expected.sum()
        if total <= 0:
            return self
        stop = float(np.clip(words / total, 0.01, 0.99))
        return self._weighted(expected / total, stop, self.part, self.offset)

    def _weighted(self, share: np.ndarray, stop: float, part: float, offset: float) -> Pieces:
        with np.errstate(divide="ignore"):  # control pieces have no weight
            weight = np.log(part * falling(self.place, offset) + (1 - part) * share) + math.log(1 - stop)
        return replace(self, weight=weight, share=share, stop=stop, part=part, offset=offset)

    def fitted(self, held: np.ndarray) -> Pieces:
        """The part and the offset that make expected counts ``held``, of occurrences that were left out, likeliest."""
        seen = held > 0
        best = (-np.inf, self.part, self.offset)
        for offset in OFFSETS if seen.any() and self.share.any() else ():
            own, share, n, part = falling(self.place, offset)[seen], self.share[seen], held[seen], 0.5
            for _ in range(200):
                part = float(np.clip((n * part * own / (part * own + (1 - part) * share)).sum() / n.sum(), 1e-4, 1 - 1e-4))
            best = max(best, (float((n * np.log(part * own + (1 - part) * share)).sum()), part, offset))
        return self._weighted(self.share, self.stop, *best[1:])


def falling(place: np.ndarray, offset: float) -> np.ndarray:
    """Weights by places, 1 together."""
    own = 1 / (offset + place)
    return own / own.sum()


def read_pieces(model_path: str) -> Pieces:
    """Pieces and first weights from a sentencepiece model with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = sp.vocab_size()
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    place = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
    inner, first, mark, byte = {}, {}, -1, np.full(256, -1)
    at = np.full(size, np.inf)
    for i in range(size):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
            at[i] = len(place)
        elif i in place:
            at[i] = place[i]
            s = sp.id_to_piece(i)
            if s == MARK:
                mark = i
            elif s.startswith(MARK):
                if MARK not in s[1:]:
                    first[s[1:].encode()] = i
            elif MARK not in s:
                inner[s.encode()] = i
    if mark < 0 or (byte < 0).any():
        raise ValueError("the vocabulary needs the blank mark alone and all bytes")
    with np.errstate(divide="ignore"):
        weight = np.log(falling(at, OFFSET)) + math.log(1 - STOP)
    return Pieces(inner, first, mark, byte, size, at, weight, np.zeros(size))


def _long_word(word: bytes, p: Pieces) -> float:
    alpha = [_NONE] * (len(word) + 1)
    alpha[0] = float(p.weight[p.mark])
    for e in range(1, len(word) + 1):
        terms = [alpha[e - 1] + p.weight[p.byte[word[e - 1]]]]
        for j in range(max(0, e - p.longest), e):
            part = word[j:e]
            if (k := p.inner.get(part)) is not None:
                terms.append(alpha[j] + p.weight[k])
            if j == 0 and (k := p.first.get(part)) is not None:
                terms.append(p.weight[k])
        top = max(terms)
        alpha[e] = float(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1]


def _alike(length: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Long words in groups of about one length, so few that a group's arrays stay small."""
    order = np.argsort(length, kind="stable")
    most, at = max(1, (1 << 21) // (WINDOW * max(1, longest))), 0
    while at < len(order):
        n = int(length[order[at]])
        fits = min(most, max(1, (1 << 20) // n))
        stop = int(np.searchsorted(length[order], n + n // 4, "right"))
        yield order[at : min(stop, at + fits)]
        at = min(stop, at + fits)


def _forward_long(w: textops.Words, start: np.ndarray, length: np.ndarray, p: Pieces, expected: np.ndarray | None, times: np.ndarray) -> np.ndarray:
    """``forward`` for a group of words of any lengths, in windows of places that share the sums before (or after) them."""
    m, n, reach = len(start), int(length.max()), max(1, p.longest)
    weight, sizes = np.append(p.weight, _NONE), np.arange(1, reach + 1)

    def arcs(a: int, b: int, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, and bytes, by word and place a..b-1 where they start (or end); pieces by size too. -1: none."""
        place = np.arange(a, b)[None, :, None]
        j, e = (place - sizes, place) if ends else (place, place + sizes)
        j, e = np.broadcast_arrays(j, e)
        ok = (j >= 0) & (e <= length[:, None, None])
        s = start[:, None, None]
        inner = np.where(ok, p.find(w.span(s + np.where(ok, j, 0), s + np.where(ok, e, 0)), 0), -1)
        return inner, np.where(ok[:, :, 0], p.byte[w.bytes[start[:, None] + np.where(ok, j, 0)[:, :, 0]]], -1)

    e = np.broadcast_to(sizes, (m, reach))
    ok = e <= length[:, None]
    s = np.broadcast_to(start[:, None], (m, reach))
    head = np.where(ok, p.find(w.span(s, s + np.where(ok, e, 0)), 1), -1)
    alpha = np.full((reach + n + 1, m), _NONE)  # sums at place x stand in row reach + x
    alpha[reach] = p.weight[p.mark]
    for a in range(1, n + 1, WINDOW):
        inner, byte = arcs(a, min(n + 1, a + WINDOW), True)
        logs, single = weight[inner], weight[byte]
        for k in range(inner.shape[1]):
            x = a + k
            sums = np.logaddexp.reduce(alpha[x : x + reach][::-1] + logs[:, k].T, axis=0)
            sums = np.logaddexp(sums, alpha[reach + x - 1] + single[:, k])
            alpha[reach + x] = np.logaddexp(sums, weight[head[:, x - 1]]) if x <= reach else sums
    whole = alpha[reach + length, np.arange(m)]
    if expected is None:
        return whole
    alpha = alpha[reach:]
    beta = np.full((n + 1 + reach, m), _NONE)
    beta[length, np.arange(m)] = 0

    def count(piece: np.ndarray, logs: np.ndarray) -> None:
        ok = piece >= 0
        expected[:] += np.bincount(piece[ok], np.exp(logs[ok]), len(expected))

    for a in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
        b = min(n, a + WINDOW)
        inner, byte = arcs(a, b, False)
        logs, single = weight[inner], weight[byte]
        for x in range(b - 1, a - 1, -1):
            sums = np.logaddexp.reduce(beta[x + 1 : x + 1 + reach] + logs[:, x - a].T, axis=0)
            beta[x] = np.logaddexp(beta[x], np.logaddexp(sums, beta[x + 1] + single[:, x - a]))
        before = (alpha[a:b] - whole + times).T
        after = beta[np.arange(a, b)[:, None] + sizes].transpose(2, 0, 1)
        count(inner, before[:, :, None] + logs + after)
        count(byte, before + single + beta[a + 1 : b + 1].T)
    count(head, weight[head] + beta[sizes].T - (whole - times)[:, None])
    expected[p.mark] += np.exp(alpha[0] + beta[0] - whole + times).sum()
    return whole


def forward(w: textops.Words, pick: np.ndarray, p: Pieces, expected: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each picked word as pieces; adds pieces' expected counts, over so many occurrences
    of each word (``times``, else one), to ``expected``."""
    out = np.zeros(len(pick))
    often = np.zeros(len(pick)) if times is None else np.log(times)
    start, length = w.start[pick], w.end[pick] - w.start[pick]
    weight = np.append(p.weight, _NONE)  # -1: no piece
    stop = math.log(p.stop / (1 - p.stop))
    long = np.flatnonzero(length > LONG)
    for group in _alike(length[long], p.longest):
        who = long[group]
        out[who] = _forward_long(w, start[who], length[who], p, expected, often[who])
    for n in np.unique(length[length <= LONG]):
        who = np.flatnonzero(length == n)
        s = start[who][:, None]
        pairs = [(j, e) for e in range(1, n + 1) for j in range(max(0, e - p.longest), e)]
        j, e = np.array(pairs).T
        inner = p.find(w.span(s + j, s + e), 0)
        head = p.find(w.span(np.broadcast_to(s, (len(who), n)), s + np.arange(1, n + 1)), 1)
        byte = p.byte[w.bytes[s + np.arange(n)]]
        arc, first, single = weight[inner], weight[head], weight[byte]
        at = {x: k for k, x in enumerate(pairs)}
        some = (inner >= 0).any(axis=0)
        alpha = np.full((n + 1, len(who)), _NONE)
        alpha[0] = p.weight[p.mark]
        for stop_at in range(1, n + 1):
            a = np.logaddexp(alpha[stop_at - 1] + single[:, stop_at - 1], first[:, stop_at - 1])
            for x in range(max(0, stop_at - p.longest), stop_at):
                if some[k := at[x, stop_at]]:
                    a = np.logaddexp(a, alpha[x] + arc[:, k])
            alpha[stop_at] = a
        out[who] = alpha[n]
        if expected is None:
            continue
        beta = np.full((n + 1, len(who)), _NONE)
        beta[n] = 0
        for x in range(n - 1, -1, -1):
            b = beta[x + 1] + single[:, x]
            for y in range(x + 1, min(n, x + p.longest) + 1):
                if some[k := at[x, y]]:
                    b = np.logaddexp(b, beta[y] + arc[:, k])
            beta[x] = b

        def count(piece: np.ndarray, logs: np.ndarray) -> None:
            ok = piece >= 0
            expected[:] += np.bincount(piece[ok], np.exp(logs[ok]), len(expected))  # noqa: B023

        whole = alpha[n] - often[who]
        count(inner, (alpha[j] + beta[e] - whole).T + arc)
        count(head, (beta[1:] - whole).T + first)
        count(byte, (alpha[:-1] + beta[1:] - whole).T + single)
        expected[p.mark] += np.exp(alpha[0] + beta[0] - whole).sum()
    return (out + stop) / math.log(10)


class Remembered:
    """Results of ``forward`` by word, in a table of fixed size where a new word takes an old one's place."""

    SLOTS = 1 << 21

    def __init__(self, pieces: Pieces):
        self.pieces, self.keys, self.logs = pieces, np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS)

    def __call__(self, w: textops.Words, keys: np.ndarray, pick: np.ndarray) -> np.ndarray:
        at = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.logs[at]
        new = np.flatnonzero((self.keys[at] != keys) | (keys == 0))
        if len(new):
            out[new] = forward(w, pick[new], self.pieces)
            self.keys[at[new]], self.logs[at[new]] = keys[new], out[new]
        return out


@dataclass
class Model:
    name: str
    pieces: Pieces
    tokens: int  # N
    distinct: int  # V
    keys: np.ndarray  # of the most frequent words, ascending, and their counts
    counts: np.ndarray

    ends: int

    @property
    def below(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.below)

    @property
    def last(self) -> float:
        """Probability that a token is the end."""
        return min(0.99, self.ends / self.tokens) if self.ends else END


def _gather(b: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans, end to end, and where each begins."""
    at = np.concatenate([[0], np.cumsum(length)])
    return b[np.repeat(start - at[:-1], length) + np.arange(at[-1])], at


def _expected(words: DataFrame, pieces: Pieces, held: bool | None = None) -> tuple[np.ndarray, int]:
    """Expected counts of pieces over all words: a row for each piece and task, summed by piece; and how many words.

    Of each word's occurrences those that are left out of the fit (``held``), the others (False) or all (None) count.
    """
    out = F.call_function("div", F.col("c") + F.pmod("key", F.lit(HELD_BACK)), F.lit(HELD_BACK))
    times = F.col("c") if held is None else out if held else F.col("c") - out
    words = words.filter("length(word) > 0").select("word", times.cast("long").alias("c")).filter("c > 0")
    sent = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, held, size, total = np.zeros(sent.value.size), [], 0, 0

        def counted() -> None:
            times = np.concatenate([b.column(1).to_numpy() for b in held]) if held else np.zeros(0)
            for w in textops.segments([x for b in held for x in b.column(0).to_pylist()]):
                forward(w, np.arange(len(w.start)), sent.value, expected, times[w.doc])
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            total += int(batch.column(1).to_numpy().sum())
            if sum(b.num_rows for b in held) >= 50_000 or size >= MOST_BYTES:  # the more words, the fewer steps for each
                counted()
                size = 0
        counted()
        seen = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(expected[seen], total))], names=["piece", "n"])

    out, total = np.zeros(pieces.size), 0
    for r in words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        if r.piece < 0:
            total = round(r.n)
        else:
            out[r.piece] = r.n  # as many rows as the vocabulary has pieces, at most
    return out, total


def learn(docs: DataFrame, model_path: str) -> tuple[Model, DataFrame, int]:
    """From rows whose crc32(doc_id) modulo 10 is not 0: the model, all words' counts (key, c), and the ends."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.filter(remainder("doc_id", 10) != 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, size, weight = 0, 0, 0
        held: list[tuple[np.ndarray, ...]] = []  # keys, counts, lengths and bytes of words

        def merged() -> pa.RecordBatch:
            keys, counts, lengths, b = (np.concatenate(x) for x in zip(*held, strict=True))
            start = np.cumsum(lengths) - lengths
            keys, pick, inverse = np.unique(keys, return_index=True, return_inverse=True)
            b, at = _gather(b, start[pick], lengths[pick])
            text = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(b.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(inverse, counts, len(keys)).astype(np.int64)), text], names=["key", "c", "word"])

        for batch in batches:
            ends += batch.num_rows
            for part in range(0, batch.num_rows, 512):
                for w in textops.segments(textops.encoded(batch.column(0).slice(part, 512))):
                    keys, pick, count = np.unique(w.hash, return_index=True, return_counts=True)
                    length = w.end[pick] - w.start[pick]
                    held.append((keys, count, length, _gather(w.bytes, w.start[pick], length)[0]))
                    size, weight = size + len(keys), weight + int(length.sum())
                    if size > 1_000_000 or weight > MOST_BYTES:
                        yield merged()
                        held, size, weight = [], 0, 0
        if held:
            yield merged()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_KEY]), pa.array([ends]), pa.array([None], pa.binary())], names=["key", "c", "word"])

    found = materialize(rows.mapInArrow(run, "key long, c long, word binary").groupBy("key").agg(F.sum("c").alias("c"), F.first("word").alias("word")))
    words = found.filter("word is not null").select("key", "c")
    pieces = read_pieces(model_path)
    for k in range(ROUNDS):
        whole = k == ROUNDS - 1
        pieces = pieces.with_counts(*_expected(found, pieces, None if whole else False))
        if k == ROUNDS - 2:
            pieces = pieces.fitted(_expected(found, pieces, True)[0])
    ends = int(found.filter("word is null").agg(F.sum("c")).first()[0] or 0)
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # The least count that is sent: from a histogram of some hundred steps.
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s)
    at, least = 0, None
    for r in sizes:
        at += r.n
        if at > MOST_SENT:
            break
        least = r.s

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())], names=["key", "c"])

    top = words.filter(step >= least).mapInArrow(packed, "key binary, c binary").collect() if least is not None else []
    keys = np.frombuffer(b"".join(r.key for r in top), np.int64).view(np.uint64)
    counts = np.frombuffer(b"".join(r.c for r in top), np.int64)
    order = np.argsort(keys)
    model = Model(uuid.uuid4().hex, pieces, int(total.n or 0) + ends, int(total.v) + (ends > 0), keys[order], counts[order], ends)
    return model, words, ends


def score(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    model, words, ends = learn(docs, model_path)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        spelt = made("lattice", m.name, lambda: Remembered(m.pieces))
        nth = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                n = b.num_rows
                sums = np.zeros((4, n))  # words, known ones, base, score
                rare: list[tuple[np.ndarray, ...]] = []
                for w in textops.segments(textops.encoded(b.column("text"))):
                    keys, pick, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                    logs = spelt(w, keys, pick)
                    at = np.minimum(np.searchsorted(m.keys, keys), max(0, len(m.keys) - 1))
                    top = m.keys[at] == keys if len(m.keys) else np.zeros(len(keys), bool)
                    c = np.where(top, m.counts[at], 0) if len(m.keys) else np.zeros(len(keys))
                    there = top[inverse]
                    sums[0] += np.bincount(w.doc, minlength=n)
                    sums[1] += np.bincount(w.doc, there, n)
                    sums[2] += np.bincount(w.doc[there], m.base(c)[inverse[there]], n)
                    sums[3] += np.bincount(w.doc, logs[inverse], n)
                    pair, times = np.unique(w.doc[~there] * len(keys) + inverse[~there], return_counts=True)
                    rare.append((pair // len(keys), keys[pair % len(keys)], times))
                doc, key, times = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64),) * 3
                order = np.argsort(doc, kind="stable")
                cut = pa.array(np.searchsorted(doc[order], np.arange(n + 1)), pa.int32())
                struct = pa.StructArray.from_arrays([pa.array(key[order].view(np.int64)), pa.array(times[order].astype(np.int32))], names=["key", "times"])
                total = sums[3] + sums[0] * math.log10(1 - m.last) + math.log10(m.last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(nth, nth + n)), b.column("doc_id"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(total), pa.ListArray.from_arrays(cut, struct)],
                    names=["nth", "doc_id", "words", "known", "base", "score", "rare"],
                )
                nth += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(
        run, f"nth long, doc_id {kind}, words long, known long, base double, score double, rare array<struct<key: long, times: int>>"
    ))
    each = rows.select("nth", F.explode("rare").alias("r")).select("nth", "r.*").join(words, "key", "left")
    sums = each.groupBy("nth").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / model.below)).alias("base2"),
    )
    zero = F.lit(0)
    return rows.drop("rare").join(sums, "nth", "left").select(
        "doc_id",
        (remainder("doc_id", 10) == 0).alias("held_out"),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", zero) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + math.log10((ends + 0.1) / model.below)).alias("base_score"),
        "score",
    )
