"""Byte-level BPE encoding and decoding of whole texts.

A text falls into pieces by the vocabulary's pattern. In a piece, a segment tree over byte positions
holds for each live symbol the rank of its pair with the next one; the root is the leftmost pair of the
least rank. A merge takes the right symbol out and renews the entries of the merged symbol and of its
left neighbour, each in logarithmic time, so that a piece of any length takes n log n steps. The trees of
many pieces of about one length are renewed together, one merge each at a time.

Pieces are encoded once for each stretch of texts and remembered in a table of bounded size per worker.

Null and empty texts have no ids. Texts of any length count whole. Equal rows are encoded each. An empty
table gives no rows. Other columns are kept, but ``text`` goes (``encode``), and columns with the names of
the results (``ids``, ``bytes`` or those asked for) are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from protospan.functions.blocks import mapped
from protospan.llm.store import python_ready

#: Pieces that a worker remembers, at most. A task that encodes and decodes has two workers, and each may come
#: to hold them.
REMEMBERED = 200_000
#: Characters of texts whose pieces are looked for together, about; longer pieces than LARGE bytes are merged alone.
STRETCH, LARGE = 1 << 20, 1 << 12
NEVER = 1 << 62
_BETWEEN = regex.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the symbol that starts here
    left = list(range(-1, n - 1))  # where the symbol before it starts
    get = ranks.get

    def entry(i: int) -> int:
        j = end[i]
        if j >= n or (k := end[j]) - i > longest:
            return NEVER
        r = get(piece[i:k])
        return NEVER if r is None else r << 32 | i

    size = 1 << max(0, (n - 1).bit_length())
    tree = [NEVER] * size + [entry(i) for i in range(n)] + [NEVER] * (size - n)
    for x in range(size - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b

    def put(i: int, value: int) -> None:
        x = i + size
        tree[x] = value
        while x > 1:
            value, other = tree[x], tree[x ^ 1]
            x >>= 1
            if other < value:
                value = other
            if tree[x] == value:
                return
            tree[x] = value

    while (best := tree[1]) < NEVER:
        i = best & 0xFFFFFFFF
        j = end[i]
        k = end[i] = end[j]
        if k < n:
            left[k] = i
        put(j, NEVER)
        put(i, entry(i))
        if i:
            put(left[i], entry(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


_made: dict[str, tuple] = {}


def made(kind: str, key, make: Callable):
    """An object that a worker keeps between tasks, the latest of its kind."""
    if _made.get(kind, ("",))[0] != key:
        _made[kind] = (key, make())
    return _made[kind][1]


class Pairs:
    """The rank of what two neighbouring symbols make together, for many pairs at a time: a hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, out = [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                x = ranks.get(token[:k])
                if x is not None and (y := ranks.get(token[k:])) is not None:
                    keys.append(x << 32 | y)
                    out.append(r)
        self.bits = max(4, 2 + len(keys).bit_length())
        key = np.array(keys, np.int64)
        slot, order = self._slot(key), np.arange(len(key))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        self.probes = 0
        while len(order):  # those whose slot is taken go one further
            free = order[self.keys[slot[order]] < 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], np.array(out, np.int64)[put]
            order = np.setdiff1d(order, put)
            slot[order] = slot[order] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = x << 32 | y
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def merge_many(pieces: list[bytes], byte: np.ndarray, pairs: Pairs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of at most ``size`` bytes (a power of two), end to end, and how many each has.

    One segment tree for each piece, all of one shape: every step merges the pair at the root of each tree
    that has one, and renews three leaves and what lies above them.
    """
    m = len(pieces)
    n = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(p.ljust(size + 1, b"\0") for p in pieces), np.uint8).reshape(m, size + 1)
    place = np.arange(size + 1)
    live = place < n[:, None]  # a symbol starts here
    symbol = np.where(live, byte[flat], 0)
    end = np.minimum(place + 1, n[:, None])  # of the symbol that starts here
    left = np.tile(place - 1, (m, 1))
    rank = np.full((m, size), -1, np.int64)
    two = live[:, 1:]
    rank[two] = pairs(symbol[:, :-1][two], symbol[:, 1:][two])
    tree = np.empty((m, 2 * size), np.int64)
    tree[:, size:] = np.where(rank < 0, NEVER, rank << 32 | place[:size])
    x = size
    while x > 1:
        tree[:, x // 2 : x] = np.minimum(tree[:, x : 2 * x : 2], tree[:, x + 1 : 2 * x : 2])
        x //= 2
    flat_tree, flat_symbol, flat_end, flat_left, flat_live = (a.reshape(-1) for a in (tree, symbol, end, left, live))
    row = np.arange(m)

    def entry(i: np.ndarray, x: np.ndarray, y: np.ndarray, some: np.ndarray) -> np.ndarray:
        r = pairs(x, y)
        return np.where(some & (r >= 0), r << 32 | i, NEVER)

    while True:
        best = flat_tree[row * (2 * size) + 1]
        row, best = row[best < NEVER], best[best < NEVER]
        if not len(row):
            break
        at, stop = row * (size + 1), n[row]
        i, made_of = best & 0xFFFFFFFF, best >> 32
        j = flat_end[at + i]
        k = flat_end[at + j]
        flat_end[at + i], flat_symbol[at + i], flat_live[at + j] = k, made_of, False
        flat_left[at + k] = i
        before = flat_left[at + i]
        has = before >= 0
        before = np.where(has, before, i)
        after = entry(i, made_of, flat_symbol[at + k], k < stop)
        up = np.where(has, entry(before, flat_symbol[at + before], made_of, has), after)
        base = row * (2 * size)
        for leaf, value in ((j, np.full(len(row), NEVER)), (i, after), (before, up)):
            x = leaf + size
            flat_tree[base + x] = value
            for _ in range(size.bit_length() - 1):
                value = np.minimum(flat_tree[base + x], flat_tree[base + (x ^ 1)])
                x = x >> 1
                flat_tree[base + x] = value
    return symbol[live], live.sum(axis=1)


class TreeEncoder:
    """Texts to packed little-endian 32-bit ids. Pieces met before are remembered, REMEMBERED at most: of those
    beyond, the half that came first stays, as frequent ones come early. Without ``cut`` a text is split at once;
    where ``cut`` matches, no piece reaches over, and long texts are taken in parts."""

    def __init__(self, pattern: str, raw: bytes, cut: regex.Pattern | None = None, size: int = REMEMBERED):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.longest, self.pairs = max(map(len, self.ranks)), Pairs(self.ranks)
        if not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("byte-level ranks need all single bytes")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.find, self.cut = regex.compile(pattern).findall, cut
        self.size, self.known = size, {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[k] = r.to_bytes(4, "little")
            else:
                by_size[1 << (len(p) - 1).bit_length()].append(k)
        for size, members in by_size.items():
            if len(members) < 8 or size > LARGE:  # too few to go together
                for k in members:
                    out[k] = np.array(merge(pieces[k], self.ranks, self.longest), "<u4").tobytes()
                continue
            most = (1 << 20) // size
            for a in range(0, len(members), most):
                some = members[a : a + most]
                ids, count = merge_many([pieces[k] for k in some], self.byte, self.pairs, size)
                packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                for k, i, j in zip(some, [0, *ends[:-1]], ends, strict=True):
                    out[k] = packed[i:j]
        return out

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.cut and len(text) - at > STRETCH:
            m = self.cut.search(text, at + STRETCH)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            split = [self.find(part) for _, part in held]
            new = [p for p in set().union(*split) if p not in self.known]
            self.known.update(zip(new, self.merged([p.encode() for p in new]), strict=True))
            of = self.known.__getitem__
            for (i, _), pieces in zip(held, split, strict=True):
                out[i].append(b"".join(map(of, pieces)))
            for p in new:
                if len(p) > 64:
                    del self.known[p]
            if len(self.known) > self.size:
                self.known = dict(islice(self.known.items(), self.size // 2))
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                if size + len(part) > STRETCH and held:
                    flush()
                held.append((i, part))
                size += len(part)
        if held:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def tree_encoder(pattern: str, raw: bytes, size: int = REMEMBERED) -> TreeEncoder:
    import public_tokenizers

    # Of this pattern it is known that what matches never reaches over a blank between two other characters.
    return TreeEncoder(pattern, raw, _BETWEEN if pattern == public_tokenizers.PATTERN else None, size)


def packed_ids(column, encoder: TreeEncoder) -> pa.Array:
    found = encoder.many(column.to_pylist())
    ends = np.cumsum([0] + [len(x) // 4 for x in found])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c.lower() != name.lower() and c not in drop]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [column], [*kept, name])


def _schema(df: DataFrame, name: str, kind: T.DataType, drop: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name.lower() != name.lower() and f.name not in drop] + [T.StructField(name, kind)])


def sent(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """A vocabulary file for the tasks, and the digest of its bytes, by which workers know what they have made of it."""
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in place of it. The rank file is read here and sent to the tasks (some 1 MB)."""
    python_ready(docs.sparkSession)
    raw, mark = sent(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made("tree", (pattern, mark), lambda: tree_encoder(pattern, raw.value))
        for batch in batches:
            for part in range(0, batch.num_rows, 256):  # ids of few texts at a time
                b = batch.slice(part, 256)
                yield _with(b, ids, packed_ids(b.column(text), encoder), (text,))

    return mapped(docs, run, _schema(docs, ids, T.ArrayType(T.IntegerType()), (text,)))


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with the bytes that their ids stand for; null ids give no bytes."""
    python_ready(rows.sparkSession)
    raw, mark = sent(rows.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table():
            return {int(b): base64.b64decode(a) for a, b in map(bytes.split, raw.value.splitlines())}

        of = made("bytes", mark, table)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                column = b.column(ids)
                ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                found = [b"".join(map(of.__getitem__, flat[i:j].tolist())) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield _with(b, out, pa.array(found, pa.binary()))

    return mapped(rows, run, _schema(rows, out, T.BinaryType()))

