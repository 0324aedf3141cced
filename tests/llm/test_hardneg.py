"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospan.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, q string, `a.b` int, N long"


def brute(rows, every, positives=5, negatives=10):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and v and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [r for r in ok if sum(x * x for x in r[1]) < 2**62]
    out = []
    for a, (i, q, y) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, p, strict=True)), j, z) for b, (j, p, z) in enumerate(ok) if b != a and len(p) == len(q))
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            fit = [(t, n) for t, n, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hardneg.hard_negatives(table, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("spread", [0.2, 1.0, 5.0])
def test_hard_negatives(spark, monkeypatch, spread):
    for name, value in (("ANCHORS", 7), ("LEAST_ROWS", 40), ("WINDOW", 8), ("PENDING", 50)):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=12)).round(3).tolist(), int(rng.integers(0, 4))) for i in range(240)]
    # Ties and repeated vectors; a label of one row; rows of another length; large components.
    rows += [(300 + i, rows[20][1], 1 + i % 2) for i in range(15)] + [(400, [2.0] * 12, 9)]
    rows += [(500 + i, [float(i), 1.0, -2.0], i % 2) for i in range(9)] + [(600 + i, [1e5 + i, -1e5, 3e4 * i], i % 2) for i in range(6)]
    rows += [(700, None, 1), (710, [], 1), (720, [None] + [1.0] * 11, 1), (730, [float("nan")] * 12, 1), (740, [float("inf")] * 12, 1), (750, [1.0] * 12, None), (760, [0.0] * 12, 2), (770, [1e300] * 12, 2), (None, [1.0] * 12, 1)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (11, [0.9, 0.5], 1), (12, [0.5, 0.1], 2), (12, [0.5, 0.1], 2), (13, [-1.0, 0.0], 2)]
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10) and len(got) == 8
    assert mined(spark, [], 10) == []
    assert mined(spark, [(10, [1.0], 1)], 10) == []


def test_bounds_hold():
    """Every score lies within its window's bounds, for any norms and angles, and bounds are of use for near rows."""
    rng = np.random.default_rng(1)
    for scale in (0.0, 1.0, 30.0, 1e6):
        x, a, r = (np.floor(256 * s * rng.normal(size=(n, 8))) for s, n in ((scale, 400), (1.0, 50), (1.0, 5)))
        x[0], a[0] = 3 * r[0], 5 * r[0]
        known = [v / np.linalg.norm(v) for v in r]
        na, nx = np.linalg.norm(a, axis=1), np.linalg.norm(x, axis=1)
        ta, tx = hardneg.angles(a, na, known), hardneg.angles(x, nx, known)
        low, high = hardneg.score_bounds(ta, na, tx, tx, nx, nx)
        exact = a.astype(object) @ x.T.astype(object)
        assert (low <= exact).all() and (exact <= high).all()
    near = np.floor(256 * (r[0] + rng.normal(size=(20, 8))))
    t = hardneg.angles(near, np.linalg.norm(near, axis=1), known)
    low, high = hardneg.score_bounds(ta[:1], na[:1], t, t, *[np.linalg.norm(near, axis=1)] * 2)
    assert (high - low < 0.1 * na[0] * np.linalg.norm(near, axis=1)).all()


def test_products_are_exact_where_floats_are_not():
    a, x = np.array([[2**30, 1]], np.int64), np.array([[2**30, 1]], np.int64)
    assert hardneg.products(a, x, 2.0**60)[0, 0] == 2**60 + 1
