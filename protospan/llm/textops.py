"""Words of many texts and their 64-bit hashes, vectorised over bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered first. Texts are laid
end to end, at most ``LIMIT`` bytes at a time (a long text is cut between words), so that memory does
not grow with a text's length, but for a single word longer than that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LIMIT = 1 << 19
SPACES = b"\t\n\x0b\x0c\r "
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

IS_SPACE = np.zeros(256, np.int8)
IS_SPACE[list(SPACES)] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, LIMIT + 65536), b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of some texts, in their order."""

    doc: np.ndarray  # index of the text
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bytes: np.ndarray  # lowered
    prefix: np.ndarray  # polynomial hashes of the bytes before each place

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any spans of bytes, equal for equal bytes."""
        return span_hash(self.prefix, start, end)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefixes(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUES[b] * powers(len(b) + 1)[0][:-1], out=out[1:])
    return out


def hash_bytes(word: bytes) -> int:
    """The hash that a word of these (lowered) bytes gets."""
    b = np.frombuffer(word, np.uint8)
    return int(span_hash(prefixes(b), np.array([0]), np.array([len(b)]))[0])


def _cut(texts: list[bytes], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        if len(t) > limit and held:  # texts stay in order
            yield held
            held, size = [], 0
        while len(t) - at > limit:
            m = _BLANK.search(t, at + limit)
            stop = m.start() if m else len(t)
            yield [(i, t[at:stop])]
            at = stop
        piece = t[at:] if at else t
        if size + len(piece) > limit and held:
            yield held
            held, size = [], 0
        if piece:
            held.append((i, piece))
            size += len(piece) + 1
    if held:
        yield held


def segments(texts: list[bytes], limit: int = LIMIT) -> Iterator[Words]:
    for held in _cut(texts, limit):
        b = LOWER[np.frombuffer(b"\n".join(x for _, x in held), np.uint8)]
        edge = np.diff(IS_SPACE[b], prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        prefix = prefixes(b)
        at = np.cumsum([0] + [len(x) + 1 for _, x in held[:-1]])
        doc = np.array([i for i, _ in held])[np.searchsorted(at, start, "right") - 1]
        yield Words(doc, span_hash(prefix, start, end), start, end, b, prefix)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and hash of every word, in order."""
    found = [(w.doc, w.hash) for w in segments(texts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])


def encoded(column) -> list[bytes]:
    """An Arrow column of texts as UTF-8; null counts as empty."""
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.to_pylist()]
