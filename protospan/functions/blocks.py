"""Run a kernel on blocks of rows of a point table."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from protospan.functions.ship import ship

#: Rows that a kernel sees at a time, at most.
ROWS = 4096
#: Bytes of prototypes or candidates that go to every task, at most.
MOST_SENT = 100_000_000


def checked(array: np.ndarray) -> np.ndarray:
    """Refuse to send more than MOST_SENT bytes to every task."""
    if array.nbytes > MOST_SENT:
        raise ValueError(f"{array.nbytes} bytes of points are too many for every task")
    return array


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a block: features, or re and im."""
    def one(name: str) -> np.ndarray:
        c = batch.column(name)
        flat = c.flatten()
        if c.null_count or flat.null_count:
            raise ValueError("a vector or a component is null; drop or impute it first")
        if batch.num_rows and len(flat) % batch.num_rows:
            raise ValueError("vectors differ in length")
        lengths = c.value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError("vectors differ in length")
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)

    return one("features") if "features" in batch.schema.names else one("re") + 1j * one("im")


def _arrow(values: np.ndarray) -> pa.Array:
    if values.ndim == 1:
        return pa.array(values)
    ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, dots included, which mapInArrow itself does not find."""
    real, out = df.columns, [f"_{k}" for k in range(len(schema))]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(real) for x in batches):
            yield b.rename_columns(out)

    kinds = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(out, schema, strict=True)])
    return df.toDF(*[f"_{k}" for k in range(len(real))]).mapInArrow(plain, kinds).toDF(*schema.names)


def add_columns(pts: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], added: str) -> DataFrame:
    """``pts`` with columns that ``kernel`` computes from the block's matrix; ``added`` is their schema."""
    ship(pts.sparkSession)
    new = T._parse_datatype_string(added)
    kept = [f for f in pts.schema if f.name not in new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                got = kernel(matrix(b))
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [_arrow(got[n]) for n in new.names], names=[f.name for f in kept] + new.names)

    return mapped(pts, run, T.StructType([*kept, *new.fields]))


def partials(pts: DataFrame, start: Callable, kernel: Callable, schema: str, finish: Callable) -> DataFrame:
    """A few rows a partition: ``kernel(held, matrix, batch)`` folds blocks into ``start()``, ``finish`` makes columns of it."""
    ship(pts.sparkSession)
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                held = kernel(held, matrix(b), b)
        got = finish(held)
        if got is not None:
            yield pa.RecordBatch.from_arrays([_arrow(np.asarray(got[n])) for n in names], names=names)

    return pts.mapInArrow(run, schema)


def summed(pts: DataFrame, fold: Callable) -> list[np.ndarray] | None:
    """Arrays that ``fold(held, matrix, batch)`` makes of blocks, added over all rows; None without rows.

    A partition sends its arrays whole, a few tasks (the root of the number of cores) add them up as they come, and one
    adds what these send: the driver gets one row, and no task holds more than two sets of arrays.
    """
    ship(pts.sparkSession)
    tasks = max(2, math.isqrt(pts.sparkSession.sparkContext.defaultParallelism))

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["arrays"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                held = fold(held, matrix(b), b)
        if held is not None:
            yield packed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column(0):
                new = pickle.loads(raw.as_py())
                held = new if held is None else [a + b for a, b in zip(held, new, strict=True)]
        if held is not None:
            yield packed(held)

    parts = pts.mapInArrow(each, "arrays binary")
    rows = parts.repartition(tasks).mapInArrow(add, "arrays binary").repartition(1).mapInArrow(add, "arrays binary").collect()
    return pickle.loads(rows[0].arrays) if rows else None


def cuts(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of rows sorted by ``key``, one for each value."""
    values = batch.column(key).to_numpy()
    ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """The parts of each value of ``key``, of batches sorted by it."""
    value, held = None, []
    for batch in batches:
        for part in cuts(batch, key):
            now = part.column(key)[0].as_py()
            if held and now != value:
                yield value, held
                held = []
            value = now
            held.append(part)
    if held:
        yield value, held
