"""The four energies and what one set of prototypes gives every row.

An energy is any object with ``name``, ``prepare`` and the methods of ``Energy`` on blocks of rows; user
energies run through the same builds and swaps. ``p`` is a positive number, or None for the worst case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.functions import kernels
from protospan.functions.blocks import add_columns, checked, summed
from protospan.functions.vectors import norm, norm2, pnorm
from protospan.operators.pairs import Prototypes, row_vector, vector_columns
from protospan.operators.prep import assert_nonneg, center


#: Fixed value: a squared distance from the span up to which a row counts as dependent on the prototypes.
DEPENDENT = 1e-8
#: Rows times candidates that are compared at a time.
PAIRS = 1 << 21


class Energy:
    """Distances of rows ``x`` to what the prototypes ``s`` (a row each) span in some sense."""

    name = ""
    #: A row this close to what the prototypes span is not drawn.
    gap = 0.0
    #: Whether ``least_parts`` gives bounds for moves that cost less than their values.
    bounded = False

    def prepare(self, pts: DataFrame) -> DataFrame:
        return pts

    def start(self, x: np.ndarray) -> np.ndarray:
        """Before the first prototype."""
        return kernels.norms(x)

    def weights(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def distance(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.start(x) if not len(s) else kernels.norms(x - self.weights(s, x) @ s)

    def without(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows by slots: the distance if the slot were empty."""
        return np.stack([self.distance(np.delete(s, t, axis=0), x) for t in range(len(s))], axis=1)

    def after_add(self, s: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Rows by candidates."""
        return np.stack([self.distance(np.vstack([s.reshape(-1, x.shape[1]), one[None]]), x) for one in c], axis=1)

    def after_swap(self, s: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Rows by candidates by slots."""
        return np.stack([self.after_add(np.delete(s, t, axis=0), x, c) for t in range(len(s))], axis=2)

    def move_parts(self, s: np.ndarray, x: np.ndarray, c: np.ndarray, p: float | None, swap: bool) -> np.ndarray:
        """Candidates by slots (one, if nothing is swapped): sum of distance^p, or its maximum, over the rows after the move."""
        step = max(1, PAIRS // max(1, len(x)))
        out = np.empty((len(c), len(s) if swap else 1))
        for at in range(0, len(c), step):
            for t in range(out.shape[1]):
                d = self.after_add(np.delete(s, t, axis=0) if swap else s, x, c[at : at + step])
                out[at : at + step, t] = d.max(axis=0) if p is None else (d**p).sum(axis=0)
        return out

    def optimality(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How far each row's weights are from the best ones; only where they are found by search."""
        return np.zeros(len(x))


class Cluster(Energy):
    """Distance to the nearest prototype; the first slot wins ties. All distances are 1 before the first."""

    name = "cluster"

    def start(self, x):
        return np.ones(len(x))

    def nearest(self, s, x):
        """Slots and distances of the nearest and the second nearest prototype."""
        d = kernels.distances(x, s)
        near = d.argmin(axis=1)
        rows = np.arange(len(x))
        dist = d[rows, near]
        if len(s) == 1:
            return near, dist, np.full(len(x), -1), np.full(len(x), np.inf)
        d[rows, near] = np.inf
        after = d.argmin(axis=1)
        return near, dist, after, d[rows, after]

    def weights(self, s, x):
        return np.eye(len(s))[self.nearest(s, x)[0]]

    def distance(self, s, x):
        return self.nearest(s, x)[1] if len(s) else self.start(x)

    def without(self, s, x):
        if len(s) == 1:
            return self.start(x)[:, None]
        near, dist, _, after = self.nearest(s, x)
        return np.where(near[:, None] == np.arange(len(s)), after[:, None], dist[:, None])

    def after_add(self, s, x, c):
        d = kernels.distances(x, c)
        return np.minimum(d, self.distance(s, x)[:, None]) if len(s) else d

    def after_swap(self, s, x, c):
        d = kernels.distances(x, c)
        if len(s) == 1:
            return d[:, :, None]
        return np.minimum(d[:, :, None], self.without(s, x)[:, None, :])


    def move_parts(self, s, x, c, p, swap):
        """As for any energy, but a row is compared only with candidates that may come close enough to matter.

        A candidate changes a row's part only if it is nearer than the nearest prototype, or, where that one's slot
        is refilled, than the next one. By the triangle inequality it is not if it lies at least the row's distance
        plus that reach from the row's nearest prototype. So rows are dealt by nearest prototype and sorted by what
        they reach, candidates by their distance from it.
        """
        if not len(s) or type(self).nearest is not Cluster.nearest or type(self).after_add is not Cluster.after_add:
            return super().move_parts(s, x, c, p, swap)
        near, dist, _, after = self.nearest(s, x)
        if swap and len(s) == 1:
            after = np.full(len(x), np.inf)
        reach = after if swap else dist
        k = len(s) if swap else 1
        power = (lambda d: d) if p is None else (lambda d: d**p)
        fold = np.maximum if p is None else np.add
        # What rows give if the candidate is far from all of them.
        out = np.zeros((len(c), k))
        gap = kernels.many_distances(c, s)
        for t in range(len(s)):
            rows = np.flatnonzero(near == t)
            rows = rows[np.argsort(-(dist[rows] + reach[rows]), kind="stable")]
            order = np.argsort(gap[:, t], kind="stable")
            away = gap[order, t]
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256]
                # The farthest a candidate may lie, a little more for roundings.
                most = (dist[r[0]] + reach[r[0]]) * (1 + 1e-9)
                n = int(np.searchsorted(away, most, side="right"))
                for lo in range(0, len(c), 1024):
                    who = order[lo : min(lo + 1024, n)] if lo < n else order[:0]
                    rest = order[max(lo, n) : lo + 1024] if lo + 1024 > n else order[:0]
                    if len(who):
                        d = kernels.many_distances(x[r], c[who])
                        own = power(np.minimum(d, reach[r][:, None]))
                        all_rows = power(np.minimum(d, dist[r][:, None]))
                        got, other = (own.max(axis=0), all_rows.max(axis=0)) if p is None else (own.sum(axis=0), all_rows.sum(axis=0))
                        self._fold(out, who, t, got, other, fold, swap)
                    if len(rest):
                        a, b = power(reach[r]), power(dist[r])
                        got, other = (a.max(), b.max()) if p is None else (a.sum(), b.sum())
                        self._fold(out, rest, t, got, other, fold, swap)
        return out

    #: Moves may be scored from below first.
    bounded = True

    def least_parts(self, s, x, c, p, swap):
        """As ``move_parts``, or a little less: from products in single precision, less what these may be wrong by.

        A product of k terms is wrong by k + 2 roundings of the sum of its terms' sizes at most, so that squared
        distances less that share of (|row| + |candidate|)^2 are not above the true ones. What a candidate saves is
        then not less than it does.
        """
        k = len(s) if swap else 1
        if k > 1 or (len(s) and not swap):
            near, dist, _, after = self.nearest(s, x)
        elif swap:
            return self.move_parts(s, x, c, p, swap)
        else:
            near, dist, after = np.zeros(len(x), int), None, None
        one = float(np.finfo(np.float32).eps) / 2  # a rounding, at most
        mid = c.mean(axis=0)
        x, c = x - mid, c - mid
        xs, cs = kernels.norms(x), kernels.norms(c)
        scale = max(xs.max(), cs.max()) or 1.0
        x, c, xs, cs = x / scale, c / scale, xs / scale, cs / scale
        slack = (x.shape[1] + 8) * one * (xs + cs.max()) ** 2 + 1e-30
        left = np.column_stack([-2 * c, np.ones(len(c)), cs**2]).astype(np.float32)
        power = scale ** (p or 1)
        whole = np.zeros((len(c), k))
        saved = np.zeros((2, k, len(c)))  # in all slots but the rows' own, and in that one
        base = np.zeros((2, k))
        side = 512
        held = np.empty((2, side * side), np.float32)
        for t in range(max(1, len(s))):
            rows = np.flatnonzero(near == t)
            for at in range(0, len(rows), side):
                r = rows[at : at + side]
                right = np.column_stack([x[r], xs[r] ** 2 - slack[r], np.ones(len(r))]).astype(np.float32).T
                limits = [] if dist is None else [z[r] / scale for z in ((dist, after) if swap else (dist,))]
                powers = [z if p is None else z**p for z in limits]
                ups = [(z * (1 + 16 * one)).astype(np.float32) for z in powers]
                if p is not None:
                    for i, z in enumerate(powers):
                        base[i, t if swap else 0] += z.sum()
                for lo in range(0, len(c), side):
                    who = slice(lo, min(lo + side, len(c)))
                    d, spare = (h[: (who.stop - lo) * len(r)].reshape(-1, len(r)) for h in held)
                    np.matmul(left[who], right, out=d)
                    if not (p == 2 and limits):
                        np.maximum(d, 0, out=d)
                    d = kernels.power(d, p)
                    if not limits:
                        got = d.max(axis=1) if p is None else d.sum(axis=1)
                        whole[who, 0] = np.maximum(whole[who, 0], got) if p is None else whole[who, 0] + got
                        continue
                    for i, up in enumerate(ups):
                        if p is None:
                            got = np.minimum(d, up[None, :], out=spare).max(axis=1)
                            mine = saved[i, t if swap else 0]
                            mine[who] = np.maximum(mine[who], got)
                        else:
                            z = np.subtract(up[None, :], d, out=d if i + 1 == len(ups) else spare)
                            np.maximum(z, 0, out=z)
                            saved[i, t if swap else 0, who] += z.sum(axis=1)
        less = 1 - 600 * one
        if dist is None:
            return whole * less * power
        if p is None:
            out = np.stack([np.max([saved[int(swap and t == slot), t] for t in range(k)], axis=0) for slot in range(k)], axis=1)
            return out * (1 - 32 * one) * power
        kept = base[:, :, None] - saved * (1 + 600 * one)
        out = np.stack([sum(kept[int(swap and t == slot), t] for t in range(k)) for slot in range(k)], axis=1)
        return np.maximum(0, out * (1 - 1e-12)) * power

    @staticmethod
    def _fold(out, who, t, own, other, fold, swap):
        """Add the parts of rows whose nearest slot is ``t``: ``own`` if that slot is refilled, else ``other``."""
        if not swap:
            out[who, 0] = fold(out[who, 0], other)
            return
        for slot in range(out.shape[1]):
            out[who, slot] = fold(out[who, slot], own if slot == t else other)


class LowRank(Energy):
    """Distance to the span; real or complex rows."""

    name = "lowrank"
    gap = DEPENDENT**0.5

    def weights(self, s, x):
        return x @ np.linalg.pinv(s)

    def distance(self, s, x):
        return kernels.norms(kernels.residual(x, kernels.basis(s))) if len(s) else self.start(x)

    def after_add(self, s, x, c):
        if len(s):
            q = kernels.basis(s)
            x, c = kernels.residual(x, q), kernels.residual(c, q)
        d, f = (abs(x) ** 2).sum(axis=1), (abs(c) ** 2).sum(axis=1)
        gain = abs(x @ c.conj().T) ** 2 / np.where(f > kernels.TINY, f, 1)
        return np.sqrt(np.maximum(0, d[:, None] - np.where(f > kernels.TINY, gain, 0)))


class _Combined(Energy):
    """Distances to combinations with weights of no less than 0."""

    total = False

    def weights(self, s, x):
        return kernels.convex(x, s) if self.total else kernels.nonnegative(x, s)

    def optimality(self, s, x):
        return kernels.optimality(x, s, self.weights(s, x), self.total)

    def beside_one(self, rest, x, c):
        """For one point: what ``_meet`` needs to know of rows and candidates, and which of them it is right for; None if it is for none."""
        return None

    @staticmethod
    def _meet(y, base, weight, unit, bend, shift, p, place):
        """For every candidate the sum of distance^p, or its maximum, over rows that also have one point.

        ``y`` is what rows lack with the point alone, ``base`` its square, ``unit`` the direction in which a candidate
        takes rows from there. With v = max(0, unit . y) the square falls by v^2, and, where the candidate's end is
        passed (or the point loses its weight), by max(0, bend v - shift weight)^2 less. ``place`` has what rows lack
        by differences; it serves where these products cancel.
        """
        total = np.zeros(len(unit))
        whole, side, straight = base.sum(), 256, (bend == 1).all()
        held = np.empty((2, side * side))
        for lo in range(0, len(unit), side):
            at = slice(lo, min(lo + side, len(unit)))
            for a in range(0, len(y), side):
                r = slice(a, min(a + side, len(y)))
                v, z = (h[: (at.stop - lo) * (r.stop - a)].reshape(-1, r.stop - a) for h in held)
                np.matmul(unit[at], y[r].T, out=v)
                np.maximum(v, 0, out=v)
                np.multiply(shift[at, None], weight[None, r], out=z)
                np.subtract(v if straight else v * bend[at, None], z, out=z)
                np.maximum(z, 0, out=z)
                if p == 2:
                    total[at] += base[r].sum() - np.einsum("ij,ij->i", v, v) + np.einsum("ij,ij->i", z, z)
                    continue
                v *= v
                z *= z
                v -= z
                np.subtract(base[None, r], v, out=v)
                i, j = np.nonzero(v < 1e-6 * base[None, r])
                for k in range(0, len(i), 1 << 14):
                    b, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    v[b, q] = place(b + lo, q + a)
                d = kernels.power(np.maximum(v, 0, out=v), p)
                total[at] = np.maximum(total[at], d.max(axis=1)) if p is None else total[at] + d.sum(axis=1)
        if p == 2:
            for i in np.flatnonzero(total < 1e-6 * whole):
                total[i] = sum(place(np.full(len(b), i), b).sum() for b in np.split(np.arange(len(y)), range(1 << 14, len(y), 1 << 14)))
        return total

    def move_parts(self, s, x, c, p, swap):
        """As for any energy, but a candidate meets only rows that it brings closer.

        By the optimality conditions a further point changes nothing for a row where its product with what the row
        lacks is not positive (for convex: not above that of the row's place). For the other rows the search
        for weights starts from the present ones. With one other point the distances are known in closed form.
        """
        out = np.zeros((len(c), len(s) if swap else 1))
        fold = np.maximum if p is None else np.add
        for t in range(out.shape[1]):
            rest = np.delete(s, t, axis=0) if swap else s.reshape(-1, x.shape[1])
            found = self.beside_one(rest, x, c) if len(rest) == 1 and len(x) else None
            if found is None:
                out[:, t] = self._searched(rest, x, c, p)
                continue
            given, rows, cands = found
            out[cands, t] = self._meet(*given[:6], p, given[6])
            if not rows.all():
                out[cands, t] = fold(out[cands, t], self._searched(rest, x[~rows], c[cands], p))
            if not cands.all():
                out[~cands, t] = self._searched(rest, x, c[~cands], p)
        return out

    def _searched(self, rest, x, c, p):
        """Sums (or maxima) for candidates beside any points, from a search for weights."""
        out = np.zeros((len(c), 1))
        power = (lambda d: d) if p is None else (lambda d: d**p)
        whole = (lambda d: d.max(initial=0)) if p is None else (lambda d: d.sum())
        step = max(1, PAIRS // max(1, len(x)))
        if self.total and not len(rest):
            for at in range(0, len(c), step):
                out[at : at + step, 0] = [whole(power(d)) for d in kernels.many_distances(c[at : at + step], x)]
            return out[:, 0]
        h = self.weights(rest, x) if len(rest) else np.zeros((len(x), 0))
        place = h @ rest
        left = x - place
        dist = kernels.norms(left)
        held = power(dist)
        for at in range(0, len(c), step):
            reach = left @ c[at : at + step].T - ((left * place).sum(axis=1)[:, None] if self.total else 0)
            near = reach > 1e-13 * dist[:, None] * kernels.norms(c[at : at + step])[None, :]
            for i in range(near.shape[1]):
                r = near[:, i]
                now = held
                if r.any():
                    points = np.vstack([rest, c[at + i]])
                    w = kernels.constrained(x[r], points, self.total, np.pad(h[r], ((0, 0), (0, 1))))
                    now = held.copy()
                    now[r] = power(np.minimum(dist[r], kernels.norms(x[r] - w @ points)))
                out[at + i, 0] = whole(now)
        return out[:, 0]


class Conic(_Combined):
    """Distance to the cone of non-negative combinations, of non-negative points."""

    name = "conic"

    def prepare(self, pts):
        return assert_nonneg(pts)

    def beside_one(self, rest, x, c):
        size = kernels.norms(rest)[0]
        if size <= kernels.TINY:
            return None
        own = rest[0] / size
        rows = x @ own >= 0
        x = x[rows]
        weight, along = x @ own, c @ own
        y, side = x - weight[:, None] * own, c - along[:, None] * own
        side -= (side @ own)[:, None] * own
        whole, off = kernels.norms(c), kernels.norms(side)
        cands = off > 1e-6 * np.maximum(whole, kernels.TINY)
        c, whole, off = c[cands], whole[cands], off[cands]
        unit, ray = side[cands] / off[:, None], c / whole[:, None]
        bend, shift = along[cands] / whole, off / whole

        def place(i, j):
            v = np.maximum(0, (y[j] * unit[i]).sum(axis=1))
            alone = bend[i] * v > shift[i] * weight[j]
            near = y[j] - v[:, None] * unit[i]
            near[alone] = x[j[alone]] - (x[j[alone]] * ray[i[alone]]).sum(axis=1)[:, None] * ray[i[alone]]
            return (near * near).sum(axis=1)

        return (y, (y * y).sum(axis=1), weight, unit, bend, shift, place), rows, cands


class Convex(_Combined):
    """Distance to the convex hull, of centred points."""

    name = "convex"
    total = True

    def beside_one(self, rest, x, c):
        y, g = x - rest[0], c - rest[0]
        size = kernels.norms(g)
        unit = g / np.where(size > 0, size, 1)[:, None]

        def place(i, j):
            far = np.clip((y[j] * unit[i]).sum(axis=1), 0, size[i])
            return ((y[j] - far[:, None] * unit[i]) ** 2).sum(axis=1)

        given = y, (y * y).sum(axis=1), np.ones(len(y)), unit, np.ones(len(c)), size, place
        return given, np.ones(len(x), bool), np.ones(len(c), bool)

    def prepare(self, pts):
        return center(pts)


ENERGIES: dict[str, Energy] = {e.name: e for e in (Cluster(), LowRank(), Conic(), Convex())}


def of(energy: str | Energy) -> Energy:
    return ENERGIES[energy] if isinstance(energy, str) else energy


# What one set of prototypes gives every row.

def cluster_assign(pts: DataFrame, chosen: Prototypes) -> DataFrame:
    """near_slot and dist."""
    return cluster_assign2(pts, chosen).drop("next_slot", "next_dist")


def cluster_assign2(pts: DataFrame, chosen: Prototypes) -> DataFrame:
    """near_slot, dist, next_slot and next_dist (-1 and infinity with one prototype)."""
    x, e = checked(chosen.x), Cluster()

    def kernel(m):
        near, dist, after, far = e.nearest(x, m)
        return {"near_slot": near.astype(np.int32), "dist": dist, "next_slot": after.astype(np.int32), "next_dist": far}

    return add_columns(pts, kernel, "near_slot int, dist double, next_slot int, next_dist double")


def cluster_update(state: DataFrame, row, slot: int) -> DataFrame:
    """Fold one more prototype into near_slot and dist; an earlier slot keeps ties."""
    from protospan.functions.vectors import distance

    d = distance("features", F.array(*[F.lit(float(v)) for v in row]))
    closer = F.col("_d") < F.col("dist")
    state = state.withColumn("_d", d)
    return state.withColumns({"near_slot": F.when(closer, slot).otherwise(F.col("near_slot")), "dist": F.least("_d", "dist")}).drop("_d")


def cluster_leave_one_out(state: DataFrame, slot: int) -> DataFrame:
    """``dist`` without one slot, from the two nearest; 1, as before the first, without the only one."""
    left = F.when(F.col("next_slot") < 0, F.lit(1.0)).otherwise(F.col("next_dist"))
    return state.withColumn("dist", F.when(F.col("near_slot") == slot, left).otherwise(F.col("dist")))


def assign(pts: DataFrame, chosen: Prototypes, energy: str | Energy, weights: bool = False, optimality: bool = False) -> DataFrame:
    """dist of every row and, if asked for, its weights in slot order (re and im parts for complex rows) and ``kkt``.

    kkt says how far conic and convex weights are from optimal, as a share of the sizes of points: some 1e-15 at the optimum.
    """
    x, e = checked(chosen.x), of(energy)
    split = np.iscomplexobj(x)

    def kernel(m):
        out = {"dist": e.distance(x, m)}
        if weights:
            w = e.weights(x, m)
            out |= {"weights": np.ascontiguousarray(w.real)} | ({"weights_im": np.ascontiguousarray(w.imag)} if split else {})
        return out | ({"kkt": e.optimality(x, m)} if optimality else {})

    return add_columns(pts, kernel, "dist double" + (", weights array<double>" + ", weights_im array<double>" * split) * weights + ", kkt double" * optimality)


def leave_one_out(pts: DataFrame, chosen: Prototypes, energy: str | Energy, out: str = "left_out") -> DataFrame:
    """The distance without each slot, in slot order."""
    x, e = checked(chosen.x), of(energy)
    return add_columns(pts, lambda m: {out: e.without(x, m)}, f"{out} array<double>")


def independent(chosen: Prototypes, row: np.ndarray) -> bool:
    """Whether a row lies farther from the span of the prototypes than counts as nothing, so that it can join them."""
    return bool(LowRank().distance(chosen.x, row[None])[0] > LowRank.gap)


def reconstruct(pts: DataFrame, chosen: Prototypes, energy: str | Energy) -> DataFrame:
    """recon (and recon_im for complex rows): every row from the prototypes by its weights."""
    x, e = checked(chosen.x), of(energy)
    if np.iscomplexobj(x):

        def parts(m):
            r = e.weights(x, m) @ x
            return {"recon": np.ascontiguousarray(r.real), "recon_im": np.ascontiguousarray(r.imag)}

        return add_columns(pts, parts, "recon array<double>, recon_im array<double>")
    return add_columns(pts, lambda m: {"recon": e.weights(x, m) @ x}, "recon array<double>")


def reconstruction_error(pts: DataFrame, chosen: Prototypes, energy: str | Energy, p: float | None = 2) -> DataFrame:
    """``reconstruct`` and ``error``: the p-norm of what is missing over the number of coordinates."""
    rows = reconstruct(pts, chosen, energy)
    if "recon_im" in rows.columns:
        re, im = (F.zip_with(a, b, lambda x, y: x - y) for a, b in (("re", "recon"), ("im", "recon_im")))
        return rows.withColumn("error", pnorm(F.zip_with(re, im, F.hypot), p) / F.size("re"))
    return rows.withColumn("error", pnorm(F.zip_with("features", "recon", lambda a, b: a - b), p) / F.size("features"))


def exemplar_nearest_mean_error(rows: DataFrame) -> int:
    """The id whose error is closest to the mean error; the least of such ids."""
    mean = rows.agg(F.avg("error")).first()[0]
    return rows.agg(F.min_by("id", F.struct(F.abs(F.col("error") - F.lit(mean)), F.col("id")))).first()[0]


# Aggregates.

def cost(dist, p: float | None):
    """The energy as an aggregate of a distance column."""
    dist = F.col(dist) if isinstance(dist, str) else dist
    return F.max(dist) if p is None else F.pow(F.sum(F.pow(dist, F.lit(float(p)))), F.lit(1.0 / p))


def energy_of(state: DataFrame, p: float | None) -> DataFrame:
    return state.agg(cost("dist", p).alias("energy"))


def normalized_energy(e, n, p: float | None):
    """A column expression: per row, so that tables of different sizes compare."""
    e, n = (F.col(x) if isinstance(x, str) else x for x in (e, n))
    return e if p is None else e / F.pow(n, F.lit(1.0 / p))


def initial_state(pts: DataFrame, energy: str) -> DataFrame:
    return pts.withColumn("dist", F.lit(1.0) if energy == "cluster" else norm("features"))


def total_sum_of_squares(pts: DataFrame) -> DataFrame:
    return pts.agg(F.sum(norm2("features")).alias("total"))


def cluster_sizes(state: DataFrame) -> DataFrame:
    return state.groupBy("near_slot").agg(F.count(F.lit(1)).alias("members"), F.sum("dist").alias("cost"))


#: Coordinates of which sums over pairs are held, at most: 32 MB.
MOST_COORDINATES = 2000


def scatter_matrix(pts: DataFrame, transform=lambda m: m) -> np.ndarray:
    """The sum of conj(x) x' over rows after a transform of their blocks; d x d."""
    def fold(held, m, _):
        if m.shape[1] > MOST_COORDINATES:
            raise ValueError(f"{m.shape[1]} coordinates are too many for a matrix of pairs of them")
        r = transform(m)
        new = [r.conj().T @ r]
        return new if held is None else [a + b for a, b in zip(held, new, strict=True)]

    got = summed(pts.select(*vector_columns(pts)), fold)
    return np.zeros((0, 0)) if got is None else got[0]


def leading_squares(pts: DataFrame, k: int, tol: float = 1e-10, seed: int = 42) -> np.ndarray:
    """The ``k`` largest squared singular values of the table, to a share ``tol`` of the largest one.

    Block Krylov iteration on the sum A of conj(x) x', which is never made: a pass over the points gives A times a
    block of vectors. The driver holds a basis of a few blocks, as long as a point has coordinates.
    """
    vec = vector_columns(pts)
    first = pts.select(*vec).first()
    d = len(row_vector(first)) if first else 0
    k = min(k, d)
    if not k:
        return np.zeros(0)

    def times(q: np.ndarray) -> np.ndarray:
        checked(q)
        return summed(pts.select(*vec), lambda held, m, _: [(m.conj().T @ (m @ q)) + (0 if held is None else held[0])])[0]

    width = min(d, k + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    moved = times(basis)
    while True:
        small = basis.conj().T @ moved
        values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        left = moved @ vectors[:, :width] - (basis @ vectors[:, :width]) * values[:width]
        size = kernels.norms(left.T)
        if size[:k].max() <= tol * max(values[0], kernels.TINY) or basis.shape[1] == d:
            return np.maximum(0, values[:k])
        if basis.shape[1] + width > 6 * width:  # keep the best two blocks
            basis, moved = basis @ vectors[:, : 2 * width], moved @ vectors[:, : 2 * width]
        new = left[:, size > 0] / size[size > 0]
        for _ in range(2):
            new = new - basis @ (basis.conj().T @ new)
            u, strength, _ = np.linalg.svd(new, full_matrices=False)
            new = u[:, strength > 1e-8]
        new = new[:, : d - basis.shape[1]]
        if not new.shape[1]:
            return np.maximum(0, values[:k])
        basis, moved = np.hstack([basis, new]), np.hstack([moved, times(new)])


def optimal_lowrank_curve(pts: DataFrame, kmax: int, p: float | None) -> DataFrame:
    """k and bound (k from 0): the least low-rank energy of any k directions, per row: a norm of the trailing singular values.

    Where the sums over pairs of coordinates would be too large, the leading values are found by iteration; they and
    the total give the bound for p = 2 and None. Any other p needs all values, and refuses such points.
    """
    spark, n = pts.sparkSession, pts.count()
    first = pts.select(*vector_columns(pts)).first()
    d = len(row_vector(first)) if first else 0
    if d > MOST_COORDINATES:
        if p not in (2, None):
            raise ValueError(f"{d} coordinates are too many for all singular values")
        squares = np.append(leading_squares(pts, kmax + 1), np.zeros(max(0, kmax + 1 - d)))
        total = pts.agg(F.sum(sum((norm2(c) for c in vector_columns(pts)), F.lit(0.0)))).first()[0] or 0.0
        rest = np.maximum(0, total - np.concatenate([[0], np.cumsum(squares)]))
        bound = [float(squares[k] ** 0.5) if p is None else float((rest[k] / n) ** 0.5) for k in range(min(kmax, d) + 1)]
        return spark.createDataFrame(list(enumerate(bound)), "k int, bound double")
    values = np.sqrt(np.maximum(0, np.linalg.eigvalsh(scatter_matrix(pts))[::-1]))
    rest = [values[k:] for k in range(min(kmax, len(values)) + 1)]
    bound = [float(v.max(initial=0)) if p is None else float((v**p).sum() ** (1 / p) / n ** (1 / p)) for v in rest]
    return spark.createDataFrame(list(enumerate(bound)), "k int, bound double")
