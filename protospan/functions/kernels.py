"""Numerical kernels on blocks of rows. No Spark here; every row's result is its own, however rows are dealt."""

from __future__ import annotations

import numpy as np

TINY = 1e-12


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows by points, from differences (exact where they are small)."""
    out = np.empty((len(x), len(points)))
    step = max(1, (1 << 20) // max(1, points.size))
    for a in range(0, len(x), step):
        d = x[a : a + step, None, :] - points[None, :, :]
        out[a : a + step] = np.sqrt((d.real**2 + d.imag**2 if np.iscomplexobj(d) else d * d).sum(axis=2))
    return out


def many_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of many rows to many points, by inner products; from differences where these cancel."""
    a, b = (x * x).sum(axis=1)[:, None], (points * points).sum(axis=1)[None, :]
    d = a + b - 2 * (x @ points.T)
    i, j = np.nonzero(d < 1e-2 * (a + b))
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[p, q] = np.sqrt(((x[p] - points[q]) ** 2).sum(axis=1))
    return d


def basis(points: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the points; points (nearly) in the span of earlier ones add none."""
    rows: list[np.ndarray] = []
    for p in points:
        r = p.copy()
        for _ in range(2):
            for q in rows:
                r = r - q * (q.conj() @ r)
        size = np.sqrt((abs(r) ** 2).sum())
        if size > 1e-6 * max(1.0, np.sqrt((abs(p) ** 2).sum())):
            rows.append(r / size)
    return np.array(rows).reshape(len(rows), points.shape[1]).astype(points.dtype)


def residual(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x - (x @ q.conj().T) @ q


def power(squares: np.ndarray, p: float | None) -> np.ndarray:
    """Distances to the power p (themselves, with p = None) from their squares; in place where it can be."""
    if p == 2:
        return squares
    d = np.sqrt(squares)
    if p is None or p == 1:
        return d
    if p == 5:
        squares *= squares
        d *= squares
        return d
    return d**p


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((abs(x) ** 2).sum(axis=1))


def _passive(g: np.ndarray, b: np.ndarray, on: np.ndarray, total: bool) -> np.ndarray:
    """Least squares on each row's own points ``on`` (with a sum of 1 if ``total``); 0 elsewhere."""
    n, k = b.shape
    m = k + total
    a = np.zeros((n, m, m))
    a[:, :k, :k] = g * (on[:, :, None] & on[:, None, :])
    a[:, np.arange(k), np.arange(k)] += ~on
    rhs = np.zeros((n, m, 1))
    rhs[:, :k, 0] = np.where(on, b, 0)
    if total:
        a[:, :k, k] = a[:, k, :k] = on
        rhs[:, k, 0] = 1
    try:
        z = np.linalg.solve(a, rhs)
        z += np.linalg.solve(a, rhs - a @ z)
    except np.linalg.LinAlgError:  # points that depend on each other: any of the best weights will do
        z = np.linalg.pinv(a, rcond=1e-13, hermitian=True) @ rhs
    return np.where(on, z[:, :k, 0], 0)


def constrained(x: np.ndarray, points: np.ndarray, total: bool, start: np.ndarray | None = None) -> np.ndarray:
    """Weights h >= 0 (of sum 1 if ``total``) of the points that come closest to each row, by active sets.

    ``start``, if given, are weights that are the best ones for the points that they use.

    A row's points with weight are solved for exactly. While a point would lower the distance, the one that does so
    most joins them; points whose weight would fall below 0 leave where it reaches 0. The distance falls with every
    step, so that no set of points comes back, and a row ends at its optimum.
    """
    k = len(points)
    if not k or not len(x):
        return np.zeros((len(x), k))
    if total:  # a common shift changes nothing but roundings
        points, x = points - (mean := points.mean(axis=0)), x - mean
    g, b = points @ points.T, x @ points.T
    size = np.sqrt(np.diag(g))
    tol = 1e-13 * k * size[None, :] * (norms(x)[:, None] + size.max())
    h, on = np.zeros((len(x), k)), np.zeros((len(x), k), bool)
    if start is not None:
        h, on = start.copy(), start > 0
    elif total:
        first = (np.diag(g)[None, :] - 2 * b).argmin(axis=1)
        h[np.arange(len(x)), first], on[np.arange(len(x)), first] = 1, True
    barred = np.zeros_like(on)
    barred[:, size <= TINY] = not total
    live = np.arange(len(x))
    for _ in range(100 * (k + 1)):
        # How fast the distance would fall with each point's weight.
        w = (x[live] - h[live] @ points) @ points.T
        if total:
            w -= (w * h[live]).sum(axis=1, keepdims=True)
        w[on[live] | barred[live] | (w <= tol[live])] = -np.inf
        new = w.argmax(axis=1)
        going = w[np.arange(len(live)), new] > -np.inf
        live, new = live[going], new[going]
        if not len(live):
            break
        on[live, new] = True
        z = _passive(g, b[live], on[live], total)
        # A point that would not get weight, by roundings, is left out until the row has moved.
        vain = z[np.arange(len(live)), new] <= 0
        on[live[vain], new[vain]], barred[live[vain], new[vain]] = False, True
        rows, z = live[~vain], z[~vain]
        while len(rows):
            low = on[rows] & (z <= 0)
            bad = low.any(axis=1)
            done = rows[~bad]
            h[done], barred[done] = z[~bad], False
            barred[done[:, None], np.flatnonzero(size <= TINY)[None, :]] = not total
            rows, z, low = rows[bad], z[bad], low[bad]
            if not len(rows):
                break
            step = np.where(low, h[rows] / np.where(low, h[rows] - z, 1), np.inf)
            out, a = step.argmin(axis=1), step.min(axis=1)
            h[rows] += a[:, None] * (z - h[rows])
            h[rows, out] = 0
            on[rows] &= h[rows] > 0
            h[rows] = np.where(on[rows], h[rows], 0)
            z = _passive(g, b[rows], on[rows], total)
    return h


def _in_parts(x: np.ndarray, points: np.ndarray, total: bool) -> np.ndarray:
    step = max(1, (1 << 21) // (len(points) + 1) ** 2)  # rows whose systems are held at a time
    parts = [constrained(x[at : at + step], points, total) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(points)))


def nonnegative(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Weights h >= 0 of the points that come closest to each row."""
    return _in_parts(x, points, False)


def convex(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Weights h >= 0 of sum 1 that come closest to each row."""
    return np.ones((len(x), 1)) if len(points) == 1 else _in_parts(x, points, True)


def optimality(x: np.ndarray, points: np.ndarray, h: np.ndarray, total: bool) -> np.ndarray:
    """How far each row's weights are from optimal: 0 at the optimum, as a share of the sizes of row and points.

    The most that a weight could still lower the distance, or that weights in use pull on it, and what is amiss with
    their sign or sum.
    """
    if not len(points):
        return np.zeros(len(x))
    if total:
        points, x = points - (mean := points.mean(axis=0)), x - mean
    w = (x - h @ points) @ points.T
    if total:
        w -= (w * h).sum(axis=1, keepdims=True)
    size = norms(points).max()
    off = np.maximum(w.max(axis=1), np.where(h > 0, abs(w), 0).max(axis=1)) / max(TINY, size * (size + norms(x).max(initial=0)))
    amiss = np.maximum(-h.min(axis=1), abs(h.sum(axis=1) - 1) if total else 0)
    return np.maximum(0, np.maximum(off, amiss))


def to_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection of each row on the non-negative vectors of sum 1."""
    u = -np.sort(-v, axis=1)
    over = np.cumsum(u, axis=1) - 1
    k = np.arange(1, v.shape[1] + 1)
    last = (u - over / k > 0).sum(axis=1)
    return np.maximum(0, v - (over[np.arange(len(v)), last - 1] / last)[:, None])
