"""Swaps: exchange prototypes of a built set."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions.blocks import add_columns, checked
from protospan.functions.vectors import uniform
from protospan.operators import scores
from protospan.operators.build import draw, rounded, with_distance
from protospan.operators.energies import Energy, LowRank, cost, of
from protospan.operators.pairs import Prototypes, prototypes, row_vector, vector_columns
from protospan.operators.prep import with_position
from protospan.operators.scores import by_sums, dealt, moved, swap_kernel

LOG = "swap_no int, seconds double, energy double, stagnation long"


@dataclass
class Swap:
    chosen: Prototypes
    energy: float
    log: list[tuple[int, float, float, int]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for every swap, and one for the end: energy after it, and rows (or trials) in vain before it."""
        return spark.createDataFrame(self.log, LOG)


def _energy(pts: DataFrame, chosen: Prototypes, e: Energy, p: float | None) -> float:
    return with_distance(pts, chosen, e).agg(cost("dist", p)).first()[0]


def close(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-8 + 1e-5 * abs(b)


def _least_gain(energy: float) -> float:
    """A value that improves an energy is lower by more than this."""
    return 1e-8 + 1e-5 * abs(energy)


def _first_hit(best: DataFrame, energy: float):
    better = (F.col("b.value") < F.lit(energy)) & (F.abs(F.col("b.value") - F.lit(energy)) > _least_gain(energy))
    return best.filter(better).agg(F.min(F.struct("turn", "id", "b")).alias("h")).first().h


def _tried(pts: DataFrame, part: DataFrame, out: Swap, e: Energy, p: float | None) -> DataFrame:
    """id, turn and the best move of every row of a chunk."""
    moves = moved(pts, part, checked(out.chosen.x), e, p, True)
    best = moves.groupBy("id").agg(F.min(F.struct(rounded(F.col("value")).alias("v"), "slot", "value")).alias("b"))
    return best.join(F.broadcast(part.select("id", "turn")), "id")  # a chunk


def _first_bounded(pts: DataFrame, part: DataFrame, out: Swap, e: Energy, p: float | None):
    """``_first_hit`` of a chunk: its rows are scored from below, and those that may improve the energy exactly, in order."""
    least = moved(pts, part, checked(out.chosen.x), e, p, True, True).groupBy("id").agg(F.min("value").alias("low"))
    may = least.filter(F.col("low") < F.lit(out.energy - _least_gain(out.energy) * (1 - 1e-6))).join(F.broadcast(part.select("id", "turn")), "id")
    ids, few = [r.id for r in may.select("id", "turn").orderBy("turn").collect()], 64  # of a chunk
    while ids:
        now, ids, few = ids[:few], ids[few:], few * 4
        hit = _first_hit(_tried(pts, part.filter(F.col("id").isin(now)), out, e, p), out.energy)
        if hit is not None:
            return hit
    return None


def swap_search(pts: DataFrame, chosen: Prototypes, energy: str | Energy = "cluster", p: float | None = 2, seed: int = 42, max_swaps: int = -1, first_chunk: int = 256, cands: DataFrame | None = None, rows: DataFrame | None = None) -> Swap:
    """Try rows (of ``cands``, if given) in cyclic id order; the first that improves the energy in some slot goes there, and the scan moves on.

    Between two swaps nothing changes, so rows are scored in chunks of the cyclic order and the first that
    improves is taken: the same swaps as one by one. Ends after a whole round in vain. ``rows``, if at hand, are the
    rows to try with their dense ``position``; ``pts`` and they should then be persisted.
    """
    e = of(energy)
    own = rows is None
    if own:
        rows = with_position(pts if cands is None else cands).persist()
        pts = dealt(pts, pts.count()).persist()
    n = rows.count()
    out = Swap(chosen, _energy(pts, chosen, e, p))
    cursor = stagnation = swaps = 0
    sums = by_sums(pts, e, p)
    chunk = n if sums else min(first_chunk, scores.fitting(pts))
    most = n if sums else scores.fitting(pts)
    began = time.perf_counter()
    while stagnation < n and (max_swaps < 0 or swaps < max_swaps):
        m = min(chunk, n - stagnation)
        turn = F.pmod(F.col("position") - cursor, F.lit(n))
        part = rows.select("id", *vector_columns(pts), turn.alias("turn")).filter((F.col("turn") < m) & ~F.col("id").isin([int(i) for i in out.chosen.ids]))
        if sums:
            values = swap_kernel(pts, checked(out.chosen.x))
            moves = add_columns(part, lambda x: {"values": values(x)}, "values array<double>")  # noqa: B023
            least = F.array_min(F.transform("values", lambda v, t: F.struct(rounded(v).alias("v"), t.alias("slot"), v.alias("value"))))
            hit = _first_hit(moves.select("id", "turn", least.alias("b")), out.energy)
        elif e.bounded and m > scores.FEW:
            hit = _first_bounded(pts, part, out, e, p)
        else:
            hit = _first_hit(_tried(pts, part, out, e, p), out.energy)
        if hit is None:
            stagnation += m
            cursor = (cursor + m) % n
            chunk = min(n, most, chunk * 4)
            continue
        swaps += 1
        new = prototypes(rows, [hit.id])
        out.chosen = out.chosen.replaced(hit.b.slot, hit.id, new.x[0])
        out.energy = hit.b.value
        out.log.append((swaps, time.perf_counter() - began, out.energy, stagnation + hit.turn))
        if not sums:  # the next one may well be as near
            chunk = min(chunk, max(first_chunk, 2 * (stagnation + hit.turn)))
        cursor, stagnation, began = (cursor + hit.turn + 1) % n, 0, time.perf_counter()
    out.log.append((swaps + 1, time.perf_counter() - began, out.energy, stagnation))
    if own:
        rows.unpersist()
        pts.unpersist()
    return out


def _slot_drawn(stay: list[float], seed: int, step: int) -> int:
    """Which of some trials in order is the first that moves, given that one does."""
    stay_all = np.append(1.0, np.cumprod(stay))[:-1]
    q = stay_all * (1 - np.array(stay))
    return int(np.random.default_rng([seed, step]).choice(len(q), p=q / q.sum()))


def swap_sampling(pts: DataFrame, chosen: Prototypes, energy: str | Energy = "cluster", p: float | None = 2, seed: int = 42) -> Swap:
    """Empty a slot, in turn, and refill it with probability in proportion to distance^p; the best set seen is returned.

    Drawing the row that was there is a trivial swap and keeps its probability. After k of them in a row
    all slots' probabilities are known: with p = None this is the end, else a slot is drawn as the first
    that would move, and its row is drawn among the others. At most 2k real swaps.
    """
    e = of(energy)
    if isinstance(e, LowRank):
        return swap_sampling_lowrank(pts, chosen, p, seed)
    k, now = len(chosen), _energy(pts, chosen, e, p)
    out, present = Swap(chosen, now), chosen
    stay: list[float] = []
    slots: list[int] = []
    slot = swaps = step = 0
    began = time.perf_counter()

    def trial(t: int):
        rest = checked(present.without(t).x)
        rows = add_columns(pts, lambda m: {"left": e.distance(rest, m)}, "left double")
        return draw(rows, "left", p, seed, f"s{step}", present.ids[t])

    while swaps < 2 * k:
        got, forced = trial(slot), False
        if got.winner is None:
            break
        step += 1
        row = got.winner
        if row.id == present.ids[slot]:
            stay.append((got.own or 0.0) / got.total)
            slots.append(slot)
            slot = (slot + 1) % k
            if len(stay) < k:
                continue
            if p is None or close(float(np.prod(stay)), 1.0):
                break
            slot, forced = slots[_slot_drawn(stay, seed, step)], True
            row = trial(slot).other
            step += 1
            if row is None:
                break
        swaps += 1
        present = present.replaced(slot, row.id, row_vector(row))
        now = _energy(pts, present, e, p)
        out.log.append((swaps, time.perf_counter() - began, now, k if forced else len(stay)))
        stay, slots, slot, began = [], [], (slot + 1) % k, time.perf_counter()
        if now < out.energy:
            out.chosen, out.energy = present, now
    # The last row has the present energy; the set returned is the best one.
    out.log.append((swaps + 1, time.perf_counter() - began, now, len(stay)))
    return out


def swap_sampling_lowrank(pts: DataFrame, chosen: Prototypes, p: float | None = 2, seed: int = 42) -> Swap:
    """As ``swap_sampling``, but one job finds the chance to stay of every slot, and a slot that moves is drawn at once.

    With p = None rows are drawn in proportion to distance itself, as for p = 1.
    """
    e, power = of("lowrank"), 1.0 if p is None else float(p)
    k, present = len(chosen), chosen
    now = _energy(pts, chosen, e, p)
    out = Swap(chosen, now)
    slot = swaps = 0
    began = time.perf_counter()
    while swaps < 2 * k:
        s = checked(present.x)
        rows = add_columns(pts, lambda m: {"left": e.without(s, m)}, "left array<double>")  # noqa: B023
        each = rows.select("id", *vector_columns(pts), F.posexplode("left").alias("slot", "d"))
        own = F.element_at(F.array(*[F.lit(int(i)) for i in present.ids]), F.col("slot") + 1)
        live = (F.col("d") > e.gap) & (F.col("id") != own)
        race = F.struct((F.log(-F.log(uniform(seed, f"l{swaps}", "id"))) - power * F.log("d")).alias("r"), "id")
        got = {r.slot: r for r in each.groupBy("slot").agg(
            F.sum(F.pow("d", F.lit(power))).alias("total"),
            F.max(F.when(F.col("id") == own, F.pow("d", F.lit(power)))).alias("own"),
            F.min_by(F.when(live, F.struct("id", *vector_columns(pts))), F.when(live, race)).alias("other"),
        ).collect()}
        order = [(slot + t) % k for t in range(k)]
        stay = [(got[t].own or 0.0) / got[t].total if got[t].total else 1.0 for t in order]
        if close(float(np.prod(stay)), 1.0):
            break
        at = _slot_drawn(stay, seed, swaps)
        row = got[order[at]].other
        if row is None:
            break
        swaps += 1
        slot = order[at]
        present = present.replaced(slot, row.id, row_vector(row))
        now = _energy(pts, present, e, p)
        out.log.append((swaps, time.perf_counter() - began, now, at))
        slot, began = (slot + 1) % k, time.perf_counter()
        if now < out.energy:
            out.chosen, out.energy = present, now
    out.log.append((swaps + 1, time.perf_counter() - began, now, 0))
    return out


SWAPS = {"search": swap_search, "sampling": swap_sampling}
