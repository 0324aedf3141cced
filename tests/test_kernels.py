"""Kernels against plain formulas."""

from itertools import combinations

import numpy as np
import pytest

from protospan.functions import kernels
from protospan.operators.energies import ENERGIES

RNG = np.random.default_rng(0)


def exact_cone(x, s):
    best = (x * x).sum()
    for r in range(1, len(s) + 1):
        for pick in combinations(range(len(s)), r):
            h = np.linalg.lstsq(s[list(pick)].T, x, rcond=None)[0]
            if (h >= -1e-12).all():
                best = min(best, ((x - h @ s[list(pick)]) ** 2).sum())
    return best**0.5


def exact_hull(x, s):
    best = np.inf
    for r in range(1, len(s) + 1):
        for pick in combinations(range(len(s)), r):
            a, rest = s[pick[0]], s[list(pick[1:])] - s[pick[0]]
            h = np.linalg.lstsq(rest.T, x - a, rcond=None)[0] if len(rest) else np.zeros(0)
            if (h >= -1e-12).all() and h.sum() <= 1 + 1e-12:
                best = min(best, ((x - a - h @ rest) ** 2).sum())
    return best**0.5


def test_cone_and_hull_are_optimal():
    x, s = np.abs(RNG.normal(size=(40, 6))), np.abs(RNG.normal(size=(4, 6)))
    assert np.allclose(ENERGIES["conic"].distance(s, x), [exact_cone(r, s) for r in x], atol=1e-6)
    x, s = RNG.normal(size=(40, 6)), RNG.normal(size=(4, 6))
    assert np.allclose(ENERGIES["convex"].distance(s, x), [exact_hull(r, s) for r in x], atol=1e-5)


def test_rows_do_not_depend_on_their_block():
    x, s = RNG.normal(size=(30, 5)), RNG.normal(size=(3, 5))
    for e in ENERGIES.values():
        whole = e.distance(s, x)
        assert np.allclose(whole, np.concatenate([e.distance(s, x[i : i + 7]) for i in range(0, 30, 7)]), atol=1e-9)


def test_order_of_energies():
    x, s = np.abs(RNG.normal(size=(50, 6))), np.abs(RNG.normal(size=(4, 6)))
    d = {n: e.distance(s, x) for n, e in ENERGIES.items()}
    for far, near in (("cluster", "convex"), ("convex", "conic"), ("conic", "lowrank")):
        assert (d[far] >= d[near] - 1e-5).all()


@pytest.mark.parametrize("name", list(ENERGIES))
def test_moves_are_what_they_say(name):
    e, x, s, c = ENERGIES[name], np.abs(RNG.normal(size=(20, 5))), np.abs(RNG.normal(size=(3, 5))), np.abs(RNG.normal(size=(2, 5)))
    add, swap, out = e.after_add(s, x, c), e.after_swap(s, x, c), e.without(s, x)
    for k in range(2):
        assert np.allclose(add[:, k], e.distance(np.vstack([s, c[k]]), x), atol=1e-6)
        for t in range(3):
            assert np.allclose(swap[:, k, t], e.distance(np.vstack([np.delete(s, t, 0), c[k]]), x), atol=1e-6)
            assert np.allclose(out[:, t], e.distance(np.delete(s, t, 0), x), atol=1e-6)


def test_complex_span():
    z = lambda *n: RNG.normal(size=n) + 1j * RNG.normal(size=n)
    s, x = z(2, 5), z(6, 5)
    x[0] = (1 + 2j) * s[0] - 3j * s[1]
    d = ENERGIES["lowrank"].distance(s, x)
    assert d[0] < 1e-9
    w = x @ np.linalg.pinv(s)
    assert np.allclose(d, np.linalg.norm(x - w @ s, axis=1))


def test_dependent_prototypes_and_ties():
    s = np.array([[1.0, 0], [2, 0], [1, 0]])
    assert len(kernels.basis(s)) == 1
    near = ENERGIES["cluster"].nearest(s, np.array([[1.0, 0]]))
    assert near[0][0] == 0 and near[2][0] == 2
    h = kernels.to_simplex(RNG.normal(size=(10, 4)))
    assert np.allclose(h.sum(axis=1), 1) and (h >= 0).all()
