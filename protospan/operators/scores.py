"""What the energy would be after one move: a candidate added, or put in a slot.

Candidates go out in chunks of a few thousand; every task compares a chunk with its points, which stay where they
are, and returns one partial sum (or maximum) for each candidate and slot. So what is shuffled is a few numbers for
each candidate and partition, and n^2 rows never exist. The cluster energy skips points that no candidate of a block
can reach. The low-rank energy with p = 2 needs only sums over the points.

A search for the best move first scores all from below, in single precision, and then those alone that may be it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.functions import kernels
from protospan.functions.blocks import add_columns, checked, matrix, partials, summed
from protospan.functions.ship import ship
from protospan.functions.tables import kept
from protospan.operators.energies import MOST_COORDINATES, Cluster, Energy, LowRank, assign, cost, of, scatter_matrix
from protospan.operators.pairs import Prototypes, vector_columns

#: Candidates that go to every task at a time, at most, and their bytes.
CANDIDATES, CHUNK_BYTES = 16384, 1 << 24
#: Rows a partition, at least, where there are more cores than partitions, and at most.
LEAST_ROWS, MOST_ROWS = 16, 1 << 17


def fitting(pts: DataFrame) -> int:
    """Candidates that go to every task at a time."""
    return max(1, min(CANDIDATES, CHUNK_BYTES // (8 * max(1, _width(pts)))))


def chunks(cands: DataFrame, rows: int, fit: int) -> Iterator[DataFrame]:
    """``cands`` (about so many ``rows``) in parts of about ``fit`` rows, dealt by id."""
    n = max(1, -(-rows // fit))
    for k in range(n):
        yield cands.filter(F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.lit(n)) == k) if n > 1 else cands


def dealt(pts: DataFrame, rows: int) -> DataFrame:
    """``pts`` in equal partitions, as many as there are cores, or more if they would be large: a file, or one part of it, may hold most rows."""
    cores = pts.sparkSession.sparkContext.defaultParallelism
    many = min(cores, rows // LEAST_ROWS) if rows <= cores * MOST_ROWS else cores * -(-rows // (cores * MOST_ROWS))
    return pts.select("id", *vector_columns(pts)).repartition(max(1, many))


def moved(pts: DataFrame, cands: DataFrame, s: np.ndarray, e: Energy, p: float | None, swap: bool, least: bool = False) -> DataFrame:
    """id, slot and value (with ``least`` a bound from below) of every move of a chunk of candidates, which goes to every
    task; a partition of points returns a number for each candidate and slot."""
    vec = vector_columns(pts)
    found = cands.select("id", *vec).toArrow().combine_chunks()  # a chunk
    spark = pts.sparkSession
    if not found.num_rows:
        return spark.createDataFrame([], "id long, slot int, value double")
    ids, c = found.column("id").to_numpy().astype(np.int64), checked(matrix(found.to_batches()[0]))
    k = len(s) if swap else 1

    def fold(held, m, _):
        new = (e.least_parts if least else e.move_parts)(s, m, c, p, swap)
        return new if held is None else np.maximum(held, new) if p is None else held + new

    def finish(held):
        return None if held is None else {"id": np.repeat(ids, k), "slot": np.tile(np.arange(k, dtype=np.int32), len(ids)), "part": held.ravel()}

    parts = partials(pts.select("id", *vec), lambda: None, fold, "id long, slot int, part double", finish)
    whole = F.max("part") if p is None else F.pow(F.sum("part"), F.lit(1.0 / p))
    return parts.groupBy("id", "slot").agg(whole.alias("value"))


def _moves(pts: DataFrame, cands: DataFrame, s: np.ndarray, e: Energy, p: float | None, swap: bool, least: bool = False) -> DataFrame:
    """``moved`` for any number of candidates, chunk by chunk."""
    fit, points, rows = fitting(pts), pts.count(), cands.count()
    pts = dealt(pts, points)
    if rows <= fit:
        return moved(pts, cands, s, e, p, swap, least)
    # Prepared once for all chunks. Each chunk's result is written before the next one goes out, so that the tasks' candidates do not add up.
    pts, cands = pts.persist(), cands.select("id", *vector_columns(cands)).persist()
    parts = [kept(moved(pts, part, s, e, p, swap, least)) for part in chunks(cands, rows, fit)]
    pts.unpersist()
    cands.unpersist()
    return reduce(DataFrame.union, parts)


def _width(pts: DataFrame) -> int:
    first = pts.select(F.size(vector_columns(pts)[0]).alias("n")).first()
    return first.n if first else 0


def by_sums(pts: DataFrame, e: Energy, p: float | None) -> bool:
    """Whether d x d sums give all values: low-rank energy, squares, and not too many coordinates."""
    return type(e) is LowRank and p == 2 and _width(pts) <= MOST_COORDINATES


def search_values(pts: DataFrame, chosen: Prototypes, energy: str | Energy, p: float | None, cands: DataFrame | None = None) -> DataFrame:
    """id and value: the energy after adding each candidate. Chosen rows get the present energy."""
    e, s = of(energy), checked(chosen.x)
    ship(pts.sparkSession)
    cands = pts if cands is None else cands
    now = assign(pts, chosen, e).agg(cost("dist", p)).first()[0] if len(chosen) else None
    taken = F.col("id").isin([int(i) for i in chosen.ids]) if len(chosen) else F.lit(False)
    if by_sums(pts, e, p):
        q = kernels.basis(s) if len(chosen) else None
        project = (lambda m: m) if q is None else (lambda m: kernels.residual(m, q))
        scatter = scatter_matrix(pts, project)
        total = np.trace(scatter).real

        def kernel(m):
            r = project(m)
            f = (abs(r) ** 2).sum(axis=1)
            gain = ((r @ scatter) * r.conj()).real.sum(axis=1) / np.where(f > kernels.TINY, f, 1)
            return {"value": np.sqrt(np.maximum(0, total - np.where(f > kernels.TINY, gain, 0)))}

        values = add_columns(cands.select("id", *vector_columns(cands)), kernel, "value double").select("id", "value")
    elif by_mean(e, chosen, p):
        values = _values_by_mean(pts, cands)
    else:
        values = _moves(pts, cands.filter(~taken), s, e, p, False).select("id", "value")
        values = values.union(cands.filter(taken).select("id", F.lit(now).cast("double")))
    return values.withColumn("value", F.when(taken, F.lit(now)).otherwise(F.col("value"))) if len(chosen) else values


def by_mean(e: Energy, chosen: Prototypes, p: float | None) -> bool:
    """Whether a row's value follows from its distance to the mean: the first prototype of a cluster energy of squares."""
    return type(e) is Cluster and p == 2 and not len(chosen)


def _values_by_mean(pts: DataFrame, cands: DataFrame) -> DataFrame:
    vec = vector_columns(pts)
    got = summed(pts.select(*vec), lambda held, m, _: [a + b for a, b in zip(held or (0, 0), (m.sum(axis=0), len(m)), strict=True)])
    mean, n = (got[0] / got[1], got[1]) if got else (np.zeros(1), 0)
    got = summed(pts.select(*vec), lambda held, m, _: [a + b for a, b in zip(held or (0, 0), ((m - mean).sum(axis=0), ((m - mean) ** 2).sum()), strict=True)])
    off, total = got or (np.zeros(1), 0.0)
    # The mean as rounded is off by a little, which ``off`` tells.
    return add_columns(cands.select("id", *vec), lambda m: {"value": np.sqrt(np.maximum(0, total - 2 * (m - mean) @ off + n * ((m - mean) ** 2).sum(axis=1)))}, "value double").select("id", "value")


#: Candidates that are scored at once, rather than from below first, and those that are then scored first.
FEW, FIRST = 1024, 64


def best_values(pts: DataFrame, chosen: Prototypes, energy: str | Energy, p: float | None, cands: DataFrame) -> DataFrame:
    """id and value, as of ``search_values``, of candidates that are not chosen, all among them that may have the least value.

    Where an energy has bounds, all candidates are scored from below; those whose bound is not above the least value of
    the few with the least bounds are scored exactly.
    """
    e, s = of(energy), checked(chosen.x)
    cands = cands.filter(~F.col("id").isin([int(i) for i in chosen.ids]))
    if not e.bounded or by_mean(e, chosen, p) or cands.count() <= FEW:
        return search_values(pts, chosen, e, p, cands)
    ship(pts.sparkSession)
    least = kept(_moves(pts, cands, s, e, p, False, True).select("id", F.col("value").alias("low")))
    first = [r.id for r in least.orderBy("low", "id").limit(FIRST).collect()]
    top = _moves(pts, cands.filter(F.col("id").isin(first)), s, e, p, False).agg(F.min("value")).first()[0]
    # A little more, for values that tie when rounded.
    may = least.filter(F.col("low") <= F.lit(top * (1 + 1e-9) + 1e-12)).select("id")
    return _moves(pts, cands.join(may, "id", "left_semi"), s, e, p, False).select("id", "value")


def swap_kernel(pts: DataFrame, s: np.ndarray):
    """For the low-rank energy with p = 2: values of putting rows in each slot, from one pass over the points.

    Without slot t the span loses one direction v_t, what prototype t has beside the others. A row's residual then
    grows by its share y_t of v_t, so that the sums of r r' for the whole set (d x d), of y_t r (k x d) and of
    |y_t|^2 (k numbers) give the energy of every move.
    """
    q = kernels.basis(s)
    v = np.zeros_like(s)
    for t in range(len(s)):
        rest = kernels.basis(np.delete(s, t, axis=0))
        r = kernels.residual(kernels.residual(s[t][None], rest), rest)[0] if len(rest) else s[t]
        size = np.sqrt((abs(r) ** 2).sum())
        # A prototype in the span of the others loses nothing with its slot.
        v[t] = r / size if size > 1e-6 * max(1.0, np.sqrt((abs(s[t]) ** 2).sum())) else 0

    def split(m):
        return kernels.residual(m, q), m @ v.conj().T

    def fold(held, m, _):
        r, y = split(m)
        new = [r.conj().T @ r, y.T @ r.conj(), (abs(y) ** 2).sum(axis=0)]
        return new if held is None else [a + b for a, b in zip(held, new, strict=True)]

    got = summed(pts.select(*vector_columns(pts)), fold)
    scatter, cross, own = got if got else (np.zeros((s.shape[1], s.shape[1])), np.zeros_like(s), np.zeros(len(s)))
    total = np.trace(scatter).real + own

    def values(m):
        r, y = split(m)
        f = (abs(r) ** 2).sum(axis=1)[:, None] + abs(y) ** 2
        # |<r_c, r_j> + conj(y_c) y_j|^2 summed over all rows j.
        gain = ((r @ scatter) * r.conj()).real.sum(axis=1)[:, None] + 2 * ((r @ cross.T) * y.conj()).real + abs(y) ** 2 * own[None, :]
        return np.where(f > kernels.TINY, np.sqrt(np.maximum(0, total[None, :] - gain / np.where(f > kernels.TINY, f, 1))), np.inf)

    return values


def swap_values(pts: DataFrame, chosen: Prototypes, energy: str | Energy, p: float | None, cands: DataFrame | None = None) -> DataFrame:
    """id, slot and value: the energy after putting each candidate that is not chosen in each slot."""
    e, s = of(energy), checked(chosen.x)
    ship(pts.sparkSession)
    cands = (pts if cands is None else cands).filter(~F.col("id").isin([int(i) for i in chosen.ids]))
    if by_sums(pts, e, p):
        values = swap_kernel(pts, s)
        rows = add_columns(cands.select("id", *vector_columns(cands)), lambda m: {"values": values(m)}, "values array<double>")
        return rows.select("id", F.posexplode("values").alias("slot", "value"))
    return _moves(pts, cands, s, e, p, True)


def swap_sampling_weights(pts: DataFrame, chosen: Prototypes, slot: int, energy: str | Energy, p: float | None) -> DataFrame:
    """id and weight for refilling one slot: the distance without it to the power p; with p = None 1 where that is largest."""
    e, s = of(energy), checked(chosen.x)
    rest = np.delete(s, slot, axis=0)
    rows = add_columns(pts, lambda m: {"left": e.distance(rest, m)}, "left double")
    if p is not None:
        return rows.select("id", F.pow("left", F.lit(float(p))).alias("weight"))
    top = rows.agg(F.max("left").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("id", F.when(F.col("left") == F.col("top"), 1.0).otherwise(0.0).alias("weight"))
