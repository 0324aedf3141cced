"""Projection, filters and preparation of point tables. Extra columns are kept, but for ``transpose``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions import kernels
from protospan.functions.blocks import matrix
from protospan.functions.ship import ship
from protospan.functions.tables import kept
from protospan.functions.vectors import norm, uniform


def drop_unlabeled(pts: DataFrame, value=0) -> DataFrame:
    return pts.filter(F.col("label") != F.lit(value))


def flatten_cube(df: DataFrame, cube_col: str = "features", label_cube_col: str | None = "labels", by: str | None = None) -> DataFrame:
    """An image of (rows, columns, bands) as a point for each pixel, id = row * columns + column; ``by`` tells several images apart."""
    own = [by] if by else []
    rows = df.select(*own, F.posexplode(cube_col).alias("_r", "_line"), *([F.col(label_cube_col).alias("_l")] if label_cube_col else []))
    cells = rows.select("*", F.size("_line").alias("_width"), F.posexplode("_line").alias("_c", "features"))
    label = [F.element_at(F.element_at("_l", F.col("_r") + 1), F.col("_c") + 1).alias("label")] if label_cube_col else []
    return cells.select(*own, (F.col("_r").cast("long") * F.col("_width") + F.col("_c")).alias("id"), F.col("features").cast("array<double>").alias("features"), *label)


def _over_all(pts: DataFrame, value) -> DataFrame:
    """``pts`` beside one aggregate of the whole table (a single row)."""
    return pts.crossJoin(F.broadcast(pts.agg(value.alias("_all"))))


def shift_nonneg(pts: DataFrame) -> DataFrame:
    """Less the least component of all, if that is negative."""
    low = F.least(F.lit(0.0), F.min(F.array_min("features")))
    return _over_all(pts, low).withColumn("features", F.transform("features", lambda x: x - F.col("_all"))).drop("_all")


def scale_by_max(pts: DataFrame) -> DataFrame:
    """Over the greatest component of all; unchanged where that is 0."""
    top = F.max(F.array_max("features"))
    return _over_all(pts, top).withColumn("features", F.when(F.col("_all") == 0, F.col("features")).otherwise(F.transform("features", lambda x: x / F.col("_all")))).drop("_all")


def l2_normalize(pts: DataFrame, zero: str = "keep") -> DataFrame:
    """Rows of norm 1. A zero row stays ("keep") or goes ("drop")."""
    out = pts.withColumn("_n", norm("features"))
    if zero == "drop":
        out = out.filter("_n > 0")
    return out.withColumn("features", F.when(F.col("_n") > 0, F.transform("features", lambda x: x / F.col("_n"))).otherwise(F.col("features"))).drop("_n")


def _missing(x):
    return x.isNull() | F.isnan(x)


def coordinate_means(pts: DataFrame) -> DataFrame:
    """pos and mean over the values that are there; summed where the rows are, then by coordinate."""
    cells = pts.select(F.posexplode("features").alias("pos", "v")).filter(~_missing(F.col("v")))
    return cells.groupBy("pos").agg(F.avg("v").alias("mean"))


def _with_means(pts: DataFrame) -> DataFrame:
    means = coordinate_means(pts).agg(F.map_from_entries(F.collect_list(F.struct("pos", "mean"))).alias("_means"))
    width = pts.agg(F.max(F.size("features")).alias("_d"))
    row = means.crossJoin(width).select(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.coalesce("_d", F.lit(1)) - 1)), lambda k: F.element_at("_means", k)).alias("_means"))
    return pts.crossJoin(F.broadcast(row))  # one row, as long as a vector


def impute_mean(pts: DataFrame) -> DataFrame:
    """Null or NaN components take their coordinate's mean; a coordinate without any value stays null."""
    return _with_means(pts).withColumn("features", F.zip_with("features", "_means", lambda x, m: F.when(_missing(x), m).otherwise(x))).drop("_means")


def center(pts: DataFrame) -> DataFrame:
    return _with_means(pts).withColumn("features", F.zip_with("features", "_means", lambda x, m: x - m)).drop("_means")


def to_float(pts: DataFrame) -> DataFrame:
    return pts.withColumn("features", F.col("features").cast("array<float>"))


def sample_exact(pts: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """``m`` rows, each set of them as likely as any other."""
    return pts.withColumn("_u", uniform(seed, "sample", "id")).orderBy("_u", "id").limit(m).drop("_u")


def sample_per_label(pts: DataFrame, rate: int, seed: int = 42, salt: int = 16) -> DataFrame:
    """``rate`` rows of every label. A label's rows are cut down in ``salt`` parts first, so that a common label is no one task's work."""
    rows = pts.withColumn("_u", uniform(seed, "stratum", "id")).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salt)))
    for by in (["label", "_s"], ["label"]):
        w = Window.partitionBy(*by).orderBy("_u", "id")
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rate).drop("_rn")
    return rows.drop("_u", "_s")


def sort_by_label(pts: DataFrame) -> DataFrame:
    return pts.orderBy("label", "id")


def with_position(pts: DataFrame) -> DataFrame:
    """A dense ``position`` from 0 by id: rows are dealt by sampled ranges of ids and sorted there, and a row's place
    adds to the sizes of earlier ranges. Written once in between, so that ranges and places stay as they are."""
    rows = kept(pts.repartitionByRange("id").sortWithinPartitions("id").withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.select("*", F.shiftrightunsigned("_m", 33).alias("_p"))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return rows.join(F.broadcast(before), "_p").withColumn("position", place).drop("_m", "_p", "_before")


def transpose_chunks(pts: DataFrame, cells: int = 1 << 21) -> DataFrame:
    """Coordinates as points, in chunks: id (a coordinate), chunk (the position of its first old point) and features, a
    component for each of the old points from there on.

    A chunk holds at most ``cells`` numbers over all coordinates, so that no row grows with the number of points.
    Labels go, as they belong to the old points.
    """
    ship(pts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, at = matrix(batch), batch.column("position").to_numpy()
            order = np.argsort(at)
            m, at = m[order], at[order]
            step = max(1, cells // max(1, m.shape[1]))
            # Neighbouring positions make a chunk.
            starts = [k for a, b in zip([0, *(np.flatnonzero(np.diff(at) != 1) + 1)], [*(np.flatnonzero(np.diff(at) != 1) + 1), len(at)], strict=True) for k in range(a, b, step)]
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                part = np.ascontiguousarray(m[a:b].T)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                columns = [pa.array(np.arange(len(part))), pa.array(np.full(len(part), at[a])), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "chunk", "features"])

    return with_position(pts.select("id", "features")).select("position", "features").mapInArrow(run, "id long, chunk long, features array<double>")


def transpose(pts: DataFrame) -> DataFrame:
    """Coordinates as points (id = coordinate), with a component for each old point by id; a row holds as many numbers as
    there were points, so for many points use ``transpose_chunks``. Labels go, as they belong to the old points."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "features"))), lambda s: s["features"]))
    return transpose_chunks(pts).groupBy("id").agg(whole.alias("features"))


def _folded(chunks: DataFrame, ids: list[int], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[Column], Column], out: str) -> DataFrame:
    """id and an array: for every point in chunks and each of ``ids`` the sum of what ``kernel`` makes of chunks."""
    ship(chunks.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        m, own = matrix(b), b.column("id").to_numpy()
        place = {i: k for k, i in enumerate(own.tolist())}
        parts = kernel(m, m[[place[i] for i in ids]])
        ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * parts.shape[1])
        return pa.table([pa.array(own), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(parts).ravel()))], names=["id", "parts"])

    parts = chunks.groupBy("chunk").applyInArrow(run, "id long, parts array<double>")
    return parts.groupBy("id").agg(F.array(*[finish(F.sum(F.element_at("parts", k + 1))) for k in range(len(ids))]).alias(out))


def chunk_distances(chunks: DataFrame, ids: list[int], out: str = "distances") -> DataFrame:
    """Euclidean distances of points in chunks to those of some ids, in their order."""
    return _folded(chunks, ids, lambda m, c: kernels.distances(m, c) ** 2, F.sqrt, out)


def chunk_products(chunks: DataFrame, ids: list[int], out: str = "products") -> DataFrame:
    """Inner products of points in chunks with those of some ids, in their order."""
    return _folded(chunks, ids, lambda m, c: m @ c.T, lambda s: s, out)


def assert_nonneg(pts: DataFrame, tol: float = 1e-13) -> DataFrame:
    low = pts.agg(F.min(F.array_min("features"))).first()[0]
    if low is not None and low < -tol:
        raise ValueError(f"points should be non-negative; the least component is {low}")
    return pts


def label_summary(pts: DataFrame) -> DataFrame:
    """label, points and dimensions of every label."""
    return pts.groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.max(F.size("features")).alias("dimensions"))
