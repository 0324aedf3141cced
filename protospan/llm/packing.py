"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. The plan needs only how many
pieces of each length there are: from the longest length down, best fit puts the pieces of a length
into the fullest sequences that still hold them, whole runs of alike sequences at a time. Each entry of
the plan gives ranks within a length their sequences and offsets, and pieces take their places by
joining on length and rank. Ranks come from counts a partition and length, so that no length's rows
meet in one task. The plan has at most a few entries for each pair of lengths, whatever the data's size.

Null text counts as empty: one token, the end. Texts of any length count whole; an empty table gives no rows. Ids stand in a piece as packed little-endian 32-bit
numbers. Documents with one doc_id are packed each on its own. With ``added`` the string of an added token in
a text is that token, as tokenizers has it unless encode_special_tokens is set; without, it is ordinary text.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protospan.llm.bpe import made, sent
from protospan.llm.store import materialize, python_ready

CAPACITY = 1024
END = 2

#: How byte-level vocabularies write bytes that are no printable characters.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    others = [b for b in range(256) if b not in _PRINTABLE]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


def vocabulary(raw: bytes) -> dict[bytes, int]:
    """Merged byte strings and ids of a tokenizers file of byte-level BPE, without its added tokens."""
    spec = json.loads(raw)
    added, letters = {t["content"] for t in spec["added_tokens"]}, byte_letters()
    return {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}


def added_ids(raw: bytes) -> dict[str, int]:
    """Strings and ids of a tokenizers file's added tokens."""
    tokens = json.loads(raw)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that depend on what stands around them are not known here")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Texts to packed little-endian 32-bit ids, by a tiktoken encoding without special tokens."""

    def __init__(self, encoding):
        self.encode = encoding.encode_to_numpy

    def __call__(self, text: str) -> bytes:
        return self.encode(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


class AddedEncoder:
    """Texts to packed ids: the ids of added tokens, the longest first, and of what lies between them."""

    def __init__(self, plain: Encoder, added: dict[str, int]):
        self.plain = plain
        self.ids = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.ids[part] if k % 2 else self.plain(part) for k, part in enumerate(self.cut.split(text)) if part)


def text_encoder(raw: bytes, added: bool = False) -> AddedEncoder:
    """The tokenizers library's ids; texts are encoded by tiktoken, which merges by the same ranks."""
    import public_tokenizers
    import tiktoken

    ranks = vocabulary(raw)
    order = sorted(ranks.values())
    if order != list(range(len(order))):
        raise ValueError("ids of byte-level BPE should follow the order of merges")
    plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return AddedEncoder(Encoder(plain), added_ids(raw) if added else {})


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids (BINARY); chunk and place number a partition's pieces of a length."""
    python_ready(docs.sparkSession)
    raw, mark = sent(docs.sparkSession, tokenizer_path)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = made("packing", (mark, added), lambda: text_encoder(raw.value, added))
        chunk, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                rows: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = (encode(text) if text else b"") + last
                    n = len(ids) // 4
                    stops = [n] if n <= capacity else [*range(n % capacity or capacity, n + 1, capacity)]
                    at = 0
                    for k, stop in enumerate(stops):
                        rows.append((doc, k, at, stop - at, ids[4 * at : 4 * stop], chunk, seen[stop - at]))
                        seen[stop - at] += 1
                        at = stop
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "chunk", "place"])

    schema = "doc_id long, piece int, start long, length long, ids binary, chunk long, place long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, on counts: (length, first rank, ranks, first sequence, offset, pieces in each sequence)."""
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first sequence, sequences)
    made_so_far = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, count: int, free: int, each: int, *, length: int = length) -> None:
            """``each`` pieces into every sequence of a run."""
            nonlocal left, rank
            out.append((length, rank, count * each, first, capacity - free, each))
            rank += count * each
            left -= count * each
            if free - each * length:
                room[free - each * length].append((first, count))

        for free in sorted(f for f in room if f >= length):
            each = free // length
            while left and room[free]:
                first, count = room[free].pop()
                whole = min(count, left // each)
                if whole:
                    put(first, whole, free, each)
                if left and whole < count:  # fewer than ``each`` are left
                    put(first + whole, 1, free, left)
                    whole += 1
                if whole < count:
                    room[free].append((first + whole, count - whole))
            if not room[free]:
                del room[free]
            if not left:
                break
        if left:
            each = capacity // length
            whole, first = left // each, made_so_far
            made_so_far += whole + (left % each > 0)
            if whole:
                put(first, whole, capacity, each)
            if left:
                put(first + whole, 1, capacity, left)
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with length, chunk and place (see ``pieces``) get sequence_id and offset. ``rows`` should be materialized."""
    counts = rows.groupBy("chunk", "length").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = rows.sparkSession.createDataFrame(plan(histogram, capacity), "length long, rank0 long, ranks long, seq0 long, offset0 long, each long")
    ranked = rows.join(counts.select("chunk", "length", "before"), ["chunk", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    inside = F.col("rank") - F.col("rank0")
    return (
        ranked.join(F.broadcast(slots), "length").filter((inside >= 0) & (inside < F.col("ranks")))
        .withColumn("sequence_id", F.col("seq0") + F.expr("(rank - rank0) div each"))
        .withColumn("offset", F.col("offset0") + (inside % F.col("each")) * F.col("length"))
        .select(*[c for c in rows.columns if c not in ("chunk", "place", "sequence_id", "offset")], "sequence_id", "offset")
    )


def packed_digests(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """The packing with a digest instead of the ids of each piece."""
    rows = pieces(docs, tokenizer_path, capacity, added=added).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(rows), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
