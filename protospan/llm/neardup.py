"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised; each of TABLES tables hashes them by WIDTH-wide steps along HASHES Gaussian
directions. Vectors of one bucket are compared exactly, in double precision. At the threshold, a cosine
of 0.95 (a distance of 0.316), one step is shared with probability 0.874, a bucket with 0.15 and one of
the buckets at least with 0.99; closer vectors are found more surely.

Equal vectors are compared once, with their number as weight. A bucket is dealt into blocks of about
BLOCK vectors, and a task sees two blocks at a time. It counts a pair only in the first table whose
bucket the pair shares, and sends link counts and a spanning forest of the links, never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with null
ids, link with nothing. Vectors of different lengths do not link. Rows that repeat a vec_id count as
vectors of their own, with one component. An empty table gives no rows. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.llm.components import components
from protospan.llm.store import materialize, python_ready
from protospan.llm.textops import mix

TABLES, HASHES, WIDTH = 28, 14, 2.0
BLOCK = 512


def directions(dim: int, tables: int, hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """A 64-bit bucket for each normalised vector (row) and table."""
    a, b = directions(x.shape[1], tables, hashes)
    steps = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, hashes)
    out = np.full((len(x), tables), x.shape[1], np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(1 << 32)
    for k in range(hashes):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, k])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(e):
    return e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            b = batch.slice(part, 256)
            packed = b.column("e").to_pylist()
            lengths = np.array([len(v) for v in packed])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = np.array([packed[i] for i in at], float)
                keys = buckets(unit(x / np.abs(x).max(axis=1, keepdims=True))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(at)) for c in ("h1", "h2", "rep", "weight")), pa.array([v.tobytes() for v in x], pa.binary()), lists],
                    names=["h1", "h2", "rep", "weight", "raw", "buckets"],
                )


def _links(table: int, block: np.ndarray, raw: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link, of two different blocks or of one, and share no bucket of an earlier table."""
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = unit(x)
    cos = u @ u.T
    cos[np.tril_indices(len(raw))] = -2
    if block[0] != block[-1]:
        cos[block[:, None] == block[None, :]] = -2
    i, j = np.nonzero(cos >= threshold - 1e-9)
    if len(i):
        # The cosine as it is defined, free of the product's order of additions.
        exact = (x[i] * x[j]).sum(axis=1) / (np.sqrt((x[i] ** 2).sum(axis=1)) * np.sqrt((x[j] ** 2).sum(axis=1)))
        ok = exact >= threshold
        i, j = i[ok], j[ok]
    if len(i) and table:
        keys = buckets(u)[:, :table]
        new = np.array([not (keys[p] == keys[q]).any() for p, q in zip(i, j, strict=True)]) if len(i) < 1000 else ~np.concatenate(
            [(keys[i[k : k + 4096]] == keys[j[k : k + 4096]]).any(axis=1) for k in range(0, len(i), 4096)])
        i, j = i[new], j[new]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def group(rows: pa.Table | pa.RecordBatch) -> None:
            if rows.num_rows < 2:
                return
            block, rep, num, weight = (rows.column(c).to_numpy() for c in ("block", "rep", "num", "weight"))
            if len(block) < 2 or (rows.column("lo")[0] != rows.column("hi")[0] and block.min() == block.max()):
                return
            i, j = _links(rows.column("tab")[0].as_py(), block, rows.column("raw").to_pylist(), threshold)
            if not len(i):
                return
            n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
            for k in np.flatnonzero(n).tolist():
                out[0].append(num[k])
                out[1].append(None)
                out[2].append(int(n[k]))
            for a, b in _forest(i, j, len(rep)):
                out[0].append(rep[a])
                out[1].append(rep[b])
                out[2].append(0)

        def given() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])
            for x in out:
                x.clear()
            return got

        held: list[pa.RecordBatch] = []  # rows of the group that is not over yet

        def whole() -> pa.Table:
            return pa.Table.from_batches(held).combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and any(held[0].column(c)[0] != batch.column(c)[a] for c in ("bucket", "lo", "hi")):
                    group(whole())
                    held.clear()
                if b < batch.num_rows and not held:
                    group(batch.slice(a, b - a))
                else:
                    held.append(batch.slice(a, b - a))
            yield given()
        if held:
            group(whole())
        yield given()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    python_ready(spark)
    e = F.col("embedding").cast("array<double>")
    # F.exists is three-valued: a null component makes the vector unusable first.
    rows = vectors.select("vec_id", F.when(F.coalesce(_usable(e), F.lit(False)) & F.col("vec_id").isNotNull(), e).alias("e"))
    rows = rows.withColumns({"h1": F.when(F.col("e").isNotNull(), F.xxhash64("e")), "h2": F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e"))})
    alike = rows.filter("e is not null").groupBy("h1", "h2").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("e").alias("e"))
    hashed = alike.mapInArrow(_hashed, "h1 long, h2 long, rep long, weight long, raw binary, buckets array<long>")
    alike = materialize(hashed.withColumn("num", F.monotonically_increasing_id()))
    # Buckets hold numbers; only vectors that share one with another are fetched.
    member = alike.select("num", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = (
        member.join(sizes, "bucket").join(alike.select("num", "rep", "weight", "raw"), "num")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tab", "block", "rep", "num", "weight", "raw")
    )
    keys = ("bucket", "lo", "hi")
    found = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(_compared(threshold), "a long, b long, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("num")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("b is not null"))
    by_rep = alike.select("h1", "h2", "rep", "num", "weight").join(counts, "num", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    by_rep = by_rep.select("h1", "h2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    # Rows without a usable vector stay out of the join, so that they do not meet in one task.
    linked = rows.filter("e is not null").select("vec_id", "h1", "h2").join(by_rep, ["h1", "h2"]).select(
        "vec_id", (F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"), "component")
    alone = rows.filter("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component"))
    return linked.union(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
