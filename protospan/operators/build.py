"""Builds: choose k prototypes one by one. Every step is a job or two; only winners reach the driver."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions.blocks import add_columns, checked, partials
from protospan.functions.vectors import uniform
from protospan.operators.energies import Energy, LowRank, cost, independent, of
from protospan.operators.pairs import Prototypes, prototypes, row_vector, vector_columns
from protospan.operators.prep import sample_exact
from protospan.operators.scores import best_values

LOG = "step int, id long, seconds double, energy double"


@dataclass
class Build:
    chosen: Prototypes
    log: list[tuple[int, int, float, float]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """step, id, seconds and energy of every prototype."""
        return spark.createDataFrame(self.log, LOG)

    @property
    def energy(self) -> float:
        return self.log[-1][3] if self.log else float("inf")


def rounded(c, digits: int = 12):
    """A value to so many significant digits, so that sums in another order tie."""
    size = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-300)))))
    return F.when(F.abs(c) < 1e-12, F.lit(0.0)).when(c == float("inf"), c).otherwise(F.round(c * size) / size)


def draw(rows: DataFrame, dist: str, p: float | None, seed: int, step, own: int | None = None, above: float = 0.0):
    """One weighted draw, as an exponential race in log space: total weight, largest distance, own weight, winner, and winner other than ``own``.

    Rows of distance 0, or up to ``above``, are never drawn. With p = None all rows at the largest distance are alike.
    """
    d = F.col(dist)
    if p is None:
        top = rows.agg(F.max(d)).first()[0]
        weight = F.when(d == F.lit(top), 1.0).otherwise(0.0)
    else:
        weight = F.pow(d, F.lit(float(p)))
    race = F.log(-F.log(uniform(seed, step, "id"))) - (F.lit(0.0) if p is None else p * F.log(d))
    live = (weight > 0) & (d > above) if p is None else d > above
    row = F.struct("id", *vector_columns(rows))
    key = F.struct(F.when(live, race).alias("r"), F.when(live, F.col("id")).alias("i"))
    other = live if own is None else live & (F.col("id") != own)
    return rows.agg(
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("total"),
        F.max(d).alias("top"),
        F.max(F.when(F.col("id") == (own if own is not None else -1), weight)).alias("own"),
        F.min_by(F.when(live, row), F.when(live, key)).alias("winner"),
        F.min_by(F.when(other, row), F.when(other, key)).alias("other"),
    ).first()


def with_distance(pts: DataFrame, chosen: Prototypes, energy: Energy, out: str = "dist") -> DataFrame:
    s = checked(chosen.x)
    return add_columns(pts, lambda m: {out: energy.distance(s, m)}, f"{out} double")


def init_set(pts: DataFrame, chosen: Prototypes, energy: str | Energy, p: float | None) -> list[float]:
    """Energies of all prefixes of a given set, from one pass over the points."""
    e, s = of(energy), checked(chosen.x)
    if not len(s):
        return []

    def fold(held, m, _):
        d = np.stack([e.distance(s[: t + 1], m) for t in range(len(s))])
        new = d.max(axis=1, initial=0) if p is None else (d**p).sum(axis=1)
        return new if held is None else np.maximum(held, new) if p is None else held + new

    rows = partials(pts.select("id", *vector_columns(pts)), lambda: None, fold, "step int, part double", lambda h: None if h is None else {"step": np.arange(len(h), dtype=np.int32), "part": h})
    got = {r.step: r.e for r in rows.groupBy("step").agg((F.max("part") if p is None else F.pow(F.sum("part"), F.lit(1.0 / p))).alias("e")).collect()}
    return [got.get(t, 0.0) for t in range(len(s))]


def build_uniform(pts: DataFrame, k: int, energy: str | Energy = "cluster", p: float | None = 2, seed: int = 42) -> Build:
    began = time.perf_counter()
    ids = [r.id for r in sample_exact(pts, k, seed).select("id", uniform(seed, "sample", "id").alias("u")).orderBy("u", "id").collect()]
    chosen = prototypes(pts, ids)
    energies = init_set(pts, chosen, energy, p)
    each = (time.perf_counter() - began) / max(1, len(ids))
    return Build(chosen, [(t, i, each, x) for t, (i, x) in enumerate(zip(ids, energies, strict=True))])


def _empty(pts: DataFrame) -> Prototypes:
    first = pts.select("id", *vector_columns(pts)).first()
    return Prototypes([], np.zeros((0, len(row_vector(first)) if first else 0)))


def build_sampling(pts: DataFrame, k: int, energy: str | Energy = "cluster", p: float | None = 2, seed: int = 42) -> Build:
    """Add rows with probability in proportion to distance^p. Ends early when all distances are 0, or, for an energy
    with a least ``gap``, when no row is left that does not (nearly) depend on the prototypes.

    A draw weighs all rows, and so finds the energy of the step before: a step is one pass, the last one two.
    """
    e, out, began = of(energy), Build(_empty(pts)), time.perf_counter()

    def close(value: float) -> None:
        nonlocal began
        now = time.perf_counter()
        out.log.append((len(out.log), out.chosen.ids[-1], now - began, value))
        began = now

    for step in range(k):
        got = draw(with_distance(pts, out.chosen, e), "dist", p, seed, step, above=e.gap)
        if step:
            close(got.top if p is None else got.total ** (1 / p))
        if got.winner is None:
            break
        out.chosen = out.chosen.added(got.winner.id, row_vector(got.winner))
    if len(out.log) < len(out.chosen):
        close(with_distance(pts, out.chosen, e).agg(cost("dist", p)).first()[0])
    return out


def build_search(pts: DataFrame, k: int, energy: str | Energy = "cluster", p: float | None = 2, seed: int = 42, cands: DataFrame | None = None) -> Build:
    """Add the row (of ``cands``, if given) that lowers the energy most; ties go by hash. Ends when every row is
    chosen, or when the best one depends on the prototypes, so that no row is of use."""
    e, out = of(energy), Build(_empty(pts))
    cands = pts if cands is None else cands
    for step in range(k):
        began = time.perf_counter()
        values = best_values(pts, out.chosen, e, p, cands)
        best = values.agg(F.min(F.struct(rounded(F.col("value")).alias("v"), uniform(seed, step, "id").alias("u"), "id", "value")).alias("b")).first().b
        if best is None:
            break
        new = prototypes(cands, [best.id])
        if isinstance(e, LowRank) and len(out.chosen) and not independent(out.chosen, new.x[0]):
            break
        out.chosen = out.chosen.added(best.id, new.x[0])
        out.log.append((step, best.id, time.perf_counter() - began, best.value))
    return out


BUILDS = {"uniform": build_uniform, "sampling": build_sampling, "search": build_search}
