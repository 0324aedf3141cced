"""Spectral embedding of the nearest-neighbour graph, by block Krylov iteration on edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.functions.blocks import add_columns, summed
from protospan.functions.tables import dropped, written
from protospan.functions.vectors import gauss
from protospan.operators.pairs import knn_join

#: Vectors beyond the wanted ones in a block, as gaps between eigenvalues are small, and blocks that a row holds.
GUARD, BLOCKS = 12, 12
#: Steps over the edges from one table that is written to the next.
STEPS = 4
#: Rows from which every step is written, so that the shuffles of the steps before can go.
MANY_ROWS = 50_000
#: Rounds after which an iteration that has not converged is given up with an error.
MOST_ROUNDS = 300


def _gram(df: DataFrame, vec: str, n: int) -> np.ndarray:
    """Sums of v v' over all rows."""
    got = summed(df.select(F.col(vec).alias("features")), lambda held, x, _: [x.T @ x if held is None else held[0] + x.T @ x])
    out = got[0] if got else np.zeros((n, n))
    return (out + out.T) / 2


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Columns of coefficients that make orthonormal vectors; directions that are only rounding are left out."""
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1.0
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    ok = values > 1e-12 * max(values[-1], 1.0)
    return vectors[:, ok] / np.sqrt(values[ok]) / size[:, None]


def spectral_embedding(pts: DataFrame, k_nn: int = 30, k: int = 15, tol: float = 1e-9, seed: int = 42, residuals: bool = False) -> DataFrame:
    """id and features: k - 1 coordinates, the leading eigenvectors of the normalised graph without the first.

    Edges join neighbours either way, with weight exp(-d^2 / (2 m^2)), m the mean neighbour distance; the
    matrix is A = (I + D^-1/2 W D^-1/2) / 2. Rows hold their components of a basis V and of A V. A round finds the
    best eigenvectors in the basis (Rayleigh-Ritz), makes their residuals R orthonormal and adds T_0(B) R to T_s-1(B) R
    to it, Chebyshev polynomials of B = 2 A - I, by s steps over the edges, which lie by source and stay where they
    are; a full basis shrinks to the best two blocks. It ends when the residuals of the k wanted vectors are below
    ``tol``; ``residuals`` adds them to every row, an array of k numbers. Signs: the coordinate of
    largest size of each vector is positive. Rows without a neighbour have no edge: their eigenvalue is 1/2. Coordinates
    beyond the number of rows are 0.
    """
    near = written(knn_join(pts, k_nn).select(F.col("id").alias("a"), F.col("neighbor").alias("b"), F.col("distance").alias("d")))
    mean = near.agg(F.avg("d")).first()[0] or 1.0
    edges = near.union(near.select("b", "a", "d")).groupBy("a", "b").agg(F.max(F.exp(-F.col("d") * F.col("d") / (2 * mean * mean))).alias("w"))
    degree = edges.groupBy("a").agg(F.sum("w").alias("g"))
    scaled = edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("g").alias("h")), "b")
    scaled = scaled.select("a", "b", (F.col("w") / F.sqrt(F.col("g") * F.col("h"))).alias("w"))
    # A row's own vectors come to it by an edge of its own, without a weight.
    own = pts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("w"))
    placed = scaled.union(own).repartition("b").persist()
    many = placed.filter(F.col("w").isNull()).count() >= MANY_ROWS
    width = k + GUARD

    def stepped_once(df: DataFrame, n: int) -> DataFrame:
        """Of id and blocks t_0, ..., t_j (in one array), also t_j+1 = 2 B t_j - t_j-1 (B t_0 if j = 0)."""
        met = placed.join(df.select(F.col("id").alias("b"), "t"), "b")
        # One text for all columns, as they are many.
        sums = ", ".join(f"coalesce(sum(w * element_at(t, size(t) - {n - i - 1})), 0D)" for i in range(n))
        got = met.groupBy("a").agg(F.expr(f"array({sums})").alias("s"), F.first(F.when(F.col("w").isNull(), F.col("t")), ignorenulls=True).alias("t"))
        # B is the graph's matrix; a block before the first is the first itself, turned.
        size = F.size("t")
        new = F.when(size == n, F.col("s")).otherwise(F.zip_with("s", F.slice("t", size - 2 * n + 1, n), lambda x, y: 2 * x - y))
        return got.select(F.col("a").alias("id"), F.concat("t", new).alias("t"))

    def grown(df: DataFrame, n: int) -> DataFrame:
        """id, v, u and a block w of n columns: STEPS blocks of polynomials of w go to v, and A times these to u.

        Of many rows, what a step no longer needs goes at once, its shuffle files too.
        """
        t, steps = df.select("id", F.col("w").alias("t")), []
        for _ in range(STEPS):
            t = stepped_once(t, n)
            if many:
                steps.append(t := written(t))
                for old in steps[-2:-1]:
                    dropped(old)
        blocks = [F.slice("t", 1 + j * n, n) for j in range(STEPS + 1)]
        moved = []
        for j in range(STEPS):
            # B t_0 = t_1, B t_j = (t_j+1 + t_j-1) / 2, and A = (I + B) / 2.
            turned = blocks[1] if j == 0 else F.zip_with(blocks[j + 1], blocks[j - 1], lambda x, y: (x + y) / 2)
            moved.append(F.zip_with(blocks[j], turned, lambda x, y: (x + y) / 2))
        both = df.select("id", "v", "u").join(t, "id")
        out = written(both.select("id", F.concat("v", *blocks[:STEPS]).alias("v"), F.concat("u", *moved).alias("u")))
        for old in steps[-1:]:
            dropped(old)
        return out

    none = F.array().cast("array<double>")
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: gauss(seed, j, "id"))
    block, m = grown(pts.select("id", none.alias("v"), none.alias("u"), start.alias("w")), width), width * STEPS
    for _ in range(MOST_ROUNDS):
        both = block.select("id", F.concat("v", "u").alias("features"))
        gram = _gram(both, "features", 2 * m)
        white = _whitening(gram[:m, :m])
        cross = white.T @ (gram[:m, m:] + gram[m:, :m]) @ white / 2
        values, vectors = np.linalg.eigh(cross)
        order = np.argsort(-values)
        values, best = values[order], white @ vectors[:, order]
        lead = best[:, :width]
        left = add_columns(both, lambda x: {"left": x[:, m:] @ lead - x[:, :m] @ (lead * values[:width])}, "left array<double>")  # noqa: B023
        rest = _gram(left, "left", lead.shape[1])
        size = np.sqrt(np.maximum(0, np.diag(rest)[:k]))
        if size.max(initial=0.0) <= tol:
            break
        keep = best[:, : 2 * width] if m + width * STEPS > BLOCKS * width else np.eye(m)
        new = _whitening(rest)

        def stepped(x: np.ndarray) -> dict[str, np.ndarray]:
            left = x[:, m:] @ lead - x[:, :m] @ (lead * values[:width])  # noqa: B023
            return {"v": x[:, :m] @ keep, "u": x[:, m:] @ keep, "w": left @ new}  # noqa: B023

        rows = add_columns(both, stepped, "v array<double>, u array<double>, w array<double>").select("id", "v", "u", "w")
        block, old, m = grown(rows, new.shape[1]), block, keep.shape[1] + new.shape[1] * STEPS
        dropped(old)
    else:
        raise RuntimeError(f"the spectral embedding has not converged in {MOST_ROUNDS} rounds")
    placed.unpersist()
    dropped(near)
    out = add_columns(both, lambda x: {"v": x[:, :m] @ lead[:, :k]}, "v array<double>").select("id", "v")
    found = min(k, lead.shape[1])
    signs = out.agg(*[F.max_by(F.element_at("v", j + 1), F.struct(F.abs(F.element_at("v", j + 1)), -F.col("id"))) for j in range(1, found)]).first() if found > 1 else []
    turned = [F.element_at("v", j + 2) * (-1.0 if s is not None and s < 0 else 1.0) for j, s in enumerate(signs)]
    features = F.array(*turned, *[F.lit(0.0)] * (k - max(found, 1))).alias("features")
    return out.select("id", features, *([F.array(*[F.lit(float(x)) for x in size]).alias("residuals")] if residuals else []))
