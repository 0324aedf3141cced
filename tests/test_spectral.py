"""The spectral embedding against a dense eigendecomposition."""

import numpy as np
import pytest

from protospan.operators import spectral
from protospan.operators.spectral import spectral_embedding


def dense(x, k_nn):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k_nn]
    dist = np.take_along_axis(d, near, axis=1)
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = np.exp(-(dist**2) / (2 * dist.mean() ** 2))
    w = np.maximum(w, w.T)
    g = w.sum(axis=1)
    values, vectors = np.linalg.eigh((np.eye(n) + w / np.sqrt(g[:, None] * g)) / 2)
    return values[::-1], vectors[:, ::-1]


def points(spark, n, d):
    x = np.random.default_rng(5).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)


def test_vectors_are_the_leading_eigenvectors(spark):
    x, pts = points(spark, 150, 12)
    values, vectors = dense(x, 6)
    assert (np.diff(values[:5]) < -1e-4).all()
    got = np.array([r.features for r in spectral_embedding(pts, 6, 4).orderBy("id").collect()])
    want = vectors[:, 1:4]
    want = want * np.sign(want[np.abs(want).argmax(axis=0), range(3)])
    assert got.shape == (150, 3) and got == pytest.approx(want, abs=1e-5)


def test_more_coordinates_than_rows(spark):
    x, pts = points(spark, 3, 2)
    got = np.array([r.features for r in spectral_embedding(pts, 2, 6).orderBy("id").collect()])
    assert got.shape == (3, 5) and not got[:, 2:].any()
    assert np.allclose(got[:, :2].T @ got[:, :2], np.eye(2))


def test_residuals_and_rows_without_neighbours(spark):
    x, pts = points(spark, 60, 5)
    rows = spectral_embedding(pts, 4, 3, residuals=True).collect()
    assert all(len(r.residuals) == 3 and max(r.residuals) <= 1e-9 for r in rows)
    assert spectral_embedding(pts.filter("id = 7"), 4, 3).collect()[0].features == [0.0, 0.0]


def test_tables_of_past_rounds_go(spark, monkeypatch):
    """Disk does not grow with rounds: all tables but the last are deleted, also those between steps."""
    x, pts = points(spark, 80, 6)
    made, gone = [], []
    plain, away = spectral.written, spectral.dropped
    monkeypatch.setattr(spectral, "MANY_ROWS", 80)
    monkeypatch.setattr(spectral, "written", lambda df: made.append(plain(df)) or made[-1])
    monkeypatch.setattr(spectral, "dropped", lambda t: gone.append((len(made), t)) or away(t))
    got = np.array([r.features for r in spectral_embedding(pts, 5, 3).orderBy("id").collect()])
    values, vectors = dense(x, 5)
    want = vectors[:, 1:3] * np.sign(vectors[:, 1:3][np.abs(vectors[:, 1:3]).argmax(axis=0), range(2)])
    assert got == pytest.approx(want, abs=1e-5)
    left = [t for t in made if all(t is not g for _, g in gone)]
    assert len(left) == 1 and left[0] is made[-1] and len(made) > spectral.STEPS
    # Two tables of steps, two of the basis and the neighbours at a time, at most.
    assert max(n - i for i, (n, _) in enumerate(gone)) <= 5
