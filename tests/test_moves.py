"""Scores of moves in chunks, from sums and for complex rows; dependent rows; the nearest-neighbour join; stored grids."""

import threading
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospan.functions import kernels
from protospan.operators import analysis, build, energies, experiment, pairs, prep, scores, swap
from protospan.sources.points import complex_points

RNG = np.random.default_rng(11)


def points(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(parts)


def whole(d, p):
    return d.max() if p is None else (d**p).sum() ** (1 / p)


@pytest.fixture(scope="module")
def clustered():
    return np.abs(RNG.normal(size=(80, 3))) * 0.2 + np.repeat(10 * np.eye(3)[[0, 1, 2, 0]], 20, axis=0) * np.repeat([1, 1, 1, 3], 20)[:, None]


@pytest.mark.parametrize("p", [1, 2, 5, None])
@pytest.mark.parametrize("name", ["cluster", "lowrank", "conic", "convex"])
def test_moves_by_chunks(spark, monkeypatch, clustered, name, p):
    monkeypatch.setattr(scores, "CANDIDATES", 9)
    monkeypatch.setattr(energies, "PAIRS", 100)
    x, e = clustered[::4], energies.of(name)
    pts = points(spark, x)
    for ids in ([2], [1, 7, 12]):
        chosen = pairs.prototypes(pts, ids)
        added = {r.id: r.value for r in scores.search_values(pts, chosen, name, p).collect()}
        for i in range(len(x)):
            s = chosen.x if i in ids else np.vstack([chosen.x, x[i]])
            assert added[i] == pytest.approx(whole(e.distance(s, x), p), rel=1e-7, abs=2e-5)
        swapped = {(r.id, r.slot): r.value for r in scores.swap_values(pts, chosen, name, p).collect()}
        assert len(swapped) == (len(x) - len(ids)) * len(ids)
        for (i, t), value in swapped.items():
            s = chosen.x.copy()
            s[t] = x[i]
            assert value == pytest.approx(whole(e.distance(s, x), p), rel=1e-7, abs=2e-5)


def test_far_candidates_are_not_compared(spark, monkeypatch, clustered):
    met = []
    plain = kernels.many_distances
    monkeypatch.setattr(kernels, "many_distances", lambda x, y: met.append(len(x) * len(y)) or plain(x, y))
    e, s = energies.of("cluster"), clustered[[0, 20, 40, 60]]
    e.move_parts(s, clustered, clustered, 2, False)
    assert sum(met) - len(clustered) * len(s) < 0.4 * len(clustered) ** 2
    d = plain(clustered, clustered)
    assert np.allclose(d, kernels.distances(clustered, clustered), rtol=1e-12, atol=0) and (np.diag(d) == 0).all()


def test_many_coordinates_go_by_chunks(spark, monkeypatch):
    x = RNG.normal(size=(25, 6))
    pts = points(spark, x)
    chosen = pairs.prototypes(pts, [0, 1])

    def values():
        return [{tuple(r[:-1]): r.value for r in f(pts, chosen, "lowrank", 2).collect()} for f in (scores.search_values, scores.swap_values)]

    by_sums = values()
    monkeypatch.setattr(scores, "MOST_COORDINATES", 5)
    assert not scores.by_sums(pts, energies.of("lowrank"), 2)
    for a, b in zip(by_sums, values(), strict=True):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-8) for k in a)


def test_dependent_prototypes_in_swaps(spark):
    """A slot whose prototype lies in the span of the others loses nothing when it is refilled."""
    x = RNG.normal(size=(20, 4))
    x[2] = x[0] - 2 * x[1]
    pts, e = points(spark, x), energies.of("lowrank")
    chosen = pairs.prototypes(pts, [0, 1, 2])
    for r in scores.swap_values(pts, chosen, "lowrank", 2).collect():
        s = chosen.x.copy()
        s[r.slot] = x[r.id]
        assert r.value == pytest.approx(whole(e.distance(s, x), 2), rel=1e-7)


def test_complex_moves(spark):
    z = RNG.normal(size=(30, 4)) + 1j * RNG.normal(size=(30, 4))
    raw = spark.createDataFrame([(i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(z)], "k long, a array<double>, b array<double>")
    pts, e = complex_points(raw, "k", "a", "b").repartition(3), energies.of("lowrank")
    assert scores.by_sums(pts, e, 2)
    chosen = pairs.prototypes(pts, [3, 8])
    for r in scores.search_values(pts, chosen, "lowrank", 2).collect():
        s = chosen.x if r.id in chosen.ids else np.vstack([chosen.x, z[r.id]])
        assert r.value == pytest.approx(whole(e.distance(s, z), 2), rel=1e-9)
    for r in scores.swap_values(pts, chosen, "lowrank", 2).collect():
        s = chosen.x.copy()
        s[r.slot] = z[r.id]
        assert r.value == pytest.approx(whole(e.distance(s, z), 2), rel=1e-9)
    for r in scores.swap_values(pts, chosen, "lowrank", 1).collect()[:10]:  # by chunks
        s = chosen.x.copy()
        s[r.slot] = z[r.id]
        assert r.value == pytest.approx(whole(e.distance(s, z), 1), rel=1e-9)
    # Builds and swaps end where no single move helps.
    got = swap.swap_search(pts, build.build_search(pts, 2, "lowrank", 2).chosen, "lowrank", 2)
    best = min(whole(e.distance(np.vstack([got.chosen.x[[1 - t]], z[i]]), z), 2) for i in range(30) for t in range(2))
    assert got.energy <= best * (1 + 1e-5)


@pytest.mark.parametrize("method", ["sampling", "search"])
@pytest.mark.parametrize("p", [2, None])
def test_dependent_rows_do_not_join(spark, method, p):
    x = RNG.normal(size=(40, 2)) @ RNG.normal(size=(2, 6))
    got = build.BUILDS[method](points(spark, x), 4, "lowrank", p)
    assert len(got.chosen) == 2 and len(got.log) == 2 and got.energy < 1e-6


def test_candidates_alone_are_chosen(spark):
    x = RNG.normal(size=(40, 3))
    pts = points(spark, x)
    some = pts.filter("id % 5 = 1")
    got = build.build_search(pts, 3, "cluster", 2, cands=some)
    assert all(i % 5 == 1 for i in got.chosen.ids)
    first = min(range(1, 40, 5), key=lambda i: whole(kernels.distances(x, x[[i]])[:, 0], 2))
    assert got.chosen.ids[0] == first
    start = pairs.prototypes(pts, [0, 2, 3])
    better = swap.swap_search(pts, start, "cluster", 2, cands=some)
    assert better.energy < build.init_set(pts, start, "cluster", 2)[-1] and all(i % 5 == 1 or i in start.ids for i in better.chosen.ids)
    values = scores.swap_values(pts, better.chosen, "cluster", 2, some)
    assert values.agg(F.min("value")).first()[0] >= better.energy * (1 - 2e-5)


def best_of_subsets(x, s, hull):
    """The least distance by trying every set of points."""
    best = np.inf if hull else (x @ x) ** 0.5
    for r in range(1, len(s) + 1):
        for pick in map(list, combinations(range(len(s)), r)):
            base = s[pick[0]] if hull else 0
            side = s[pick[1:]] - base if hull else s[pick]
            h = np.linalg.lstsq(side.T, x - base, rcond=None)[0] if len(side) else np.zeros(0)
            if (h >= -1e-12).all() and (not hull or h.sum() <= 1 + 1e-12):
                best = min(best, np.linalg.norm(x - base - (h @ side if len(side) else 0)))
    return best


@pytest.mark.parametrize("name", ["conic", "convex"])
def test_nearly_collinear_prototypes(spark, name):
    base = np.abs(RNG.normal(size=5)) + 0.5
    s = base * np.linspace(0.9, 1.1, 6)[:, None] + 1e-4 * RNG.normal(size=(6, 5))
    x = np.vstack([base * RNG.uniform(0.5, 1.5, (100, 1)) + 1e-3 * RNG.normal(size=(100, 5)), base + 1e-4 * RNG.normal(size=(100, 5))])
    pts = points(spark, x)
    rows = energies.assign(pts, pairs.Prototypes(list(range(6)), s), name, weights=True, optimality=True).orderBy("id").collect()
    want = [best_of_subsets(r, s, name == "convex") for r in x]
    assert np.allclose([r.dist for r in rows], want, atol=1e-8)
    assert max(r.kkt for r in rows) < 1e-11
    w = np.array([r.weights for r in rows])
    assert (w >= 0).all() and (name == "conic" or np.allclose(w.sum(axis=1), 1, atol=1e-9))


def test_equal_and_zero_prototypes():
    x, s = np.abs(RNG.normal(size=(30, 4))), np.abs(RNG.normal(size=(5, 4)))
    s[3], s[4] = s[1], 0
    for name, hull in (("conic", False), ("convex", True)):
        assert np.allclose(energies.of(name).distance(s, x), [best_of_subsets(r, s, hull) for r in x], atol=1e-8)
        assert kernels.optimality(x, s, energies.of(name).weights(s, x), hull).max() < 1e-11
    bad = np.full((30, 5), 0.2)
    assert kernels.optimality(x, s, bad, False).min() > 1e-3


def near_by_force(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}


@pytest.mark.parametrize("blocks,rows", [(1, 4096), (1, 16), (6, 4096), (6, 8), (40, 8)])
def test_knn_by_pivots(spark, clustered, blocks, rows):
    x = np.vstack([clustered, clustered[:7], clustered[[3] * 6], [[500.0, 0, 0]]])
    want, got = near_by_force(x, 4), {}
    for r in pairs.knn_join(points(spark, x), 4, blocks=blocks, rows_a_block=rows).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbor, r.distance))
    for i, near in want.items():
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n, j) for n, (_, j) in enumerate(near, 1)]
        assert np.allclose([d for _, _, d in sorted(got[i])], [d for d, _ in near])


@pytest.mark.parametrize("k,blocks,rows", [(4, 6, 8), (40, 40, 8)])
def test_knn_where_blocks_go_to_rows(spark, monkeypatch, clustered, k, blocks, rows):
    """Rows alike far from all others are not copied to every block."""
    monkeypatch.setattr(pairs, "COPIES", 0.01)
    monkeypatch.setattr(pairs, "SENT_BYTES", 8 * 3 * 40)
    monkeypatch.setattr(pairs, "MET", 16)
    x = np.vstack([clustered, clustered[:7], clustered[[3] * 6], [[500.0, 0, 0]]])
    shuffled, plain = [], pairs._by_parts
    monkeypatch.setattr(pairs, "_by_parts", lambda *a: shuffled.append(1) or plain(*a))
    want, got = near_by_force(x, k), {}
    for r in pairs.knn_join(points(spark, x), k, blocks=blocks, rows_a_block=rows).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbor, r.distance))
    assert shuffled
    for i, near in want.items():
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n, j) for n, (_, j) in enumerate(near, 1)]
        assert np.allclose([d for _, _, d in sorted(got[i])], [d for d, _ in near])


def test_knn_of_few_rows(spark):
    assert pairs.knn_join(points(spark, np.zeros((0, 2))), 3).count() == 0
    assert pairs.knn_join(points(spark, np.ones((1, 2))), 3).count() == 0
    assert {(r.id, r.neighbor) for r in pairs.knn_join(points(spark, np.ones((3, 2))), 5).collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}


class Stopped(Exception):
    pass


def test_a_stopped_grid_goes_on(spark, clustered, tmp_path, monkeypatch):
    pts, path = points(spark, clustered), str(tmp_path / "grid")
    plan = experiment.grid(spark, "t", "cluster", ["sampling", "uniform", "sampling_sampling", "search_search"], [2], 1, 3)
    done, plain = [], experiment.write_results

    def stops(df, to):
        if len(done) == 2:
            raise Stopped
        done.append(df.first().method)
        plain(df, to)

    monkeypatch.setattr(experiment, "write_results", stops)
    with pytest.raises(Stopped):
        experiment.run_grid(pts, plan, path)
    assert done == ["sampling", "uniform"]
    assert {r.method for r in experiment.pending_runs(plan, experiment.stored_runs(spark, path)).collect()} == {"sampling_sampling", "search_search"}
    done.clear()
    monkeypatch.setattr(experiment, "write_results", lambda df, to: done.append(df.first().method) or plain(df, to))
    built = []
    monkeypatch.setattr(experiment, "BUILDS", {n: lambda *a, n=n, f=f: built.append(n) or f(*a) for n, f in build.BUILDS.items()})
    steps, swaps, sets = experiment.run_grid(pts, plan, path)
    assert done == ["sampling_sampling", "search_search"] and built == ["search"]  # the sampled build is read back
    again = experiment.run_grid(pts, plan, path)
    assert len(done) == 2 and again[1].count() == swaps.count()
    # Swaps start from every prefix of the build.
    assert {(r.method, r.k) for r in swaps.collect()} == {(m, k) for m in ("sampling_sampling", "search_search") for k in (1, 2, 3)}
    by_k = analysis.energy_by_k(steps, swaps, len(clustered), 2)
    assert {r.k for r in by_k.filter("method = 'search_search'").collect()} == {1, 2, 3}
    ids = [r.id for r in steps.filter("method = 'sampling'").orderBy("step").collect()]
    one = swap.swap_sampling(pts, pairs.prototypes(pts, ids[:2]), "cluster", 2, 42)
    assert [r.id for r in sets.filter("method = 'sampling_sampling' and k = 2").orderBy("slot").collect()] == one.chosen.ids
    experiment.run_grid(pts, plan, path, overwrite=("uniform",))
    assert done[2:] == ["uniform"]


def test_runs_of_a_grid_go_on_together(spark, clustered, tmp_path, monkeypatch):
    both, stored, plain = threading.Barrier(2, timeout=60), [], experiment.write_results

    def waits(*a):
        both.wait()  # until another build is under way
        return build.build_uniform(*a)

    monkeypatch.setattr(experiment, "BUILDS", {"sampling": waits, "uniform": waits})
    monkeypatch.setattr(experiment, "write_results", lambda df, to: stored.append(df.first().method) or plain(df, to))
    plan = experiment.grid(spark, "t", "cluster", ["uniform", "sampling"], [2], 1, 2)
    experiment.run_grid(points(spark, clustered[:20]), plan, str(tmp_path / "g"))
    assert stored == ["sampling", "uniform"]


def test_oversampled_builds_in_a_grid(spark, clustered, tmp_path):
    pts = points(spark, clustered[:30])
    plan = experiment.grid(spark, "t", "lowrank", ["sampling", "sampling_sampling"], [2, None], 2, 2, 3, ("sampling",))
    steps, swaps, sets = experiment.run_grid(pts, plan, str(tmp_path / "g"), prefixes=False)
    assert {r["count"] for r in steps.groupBy("p", "seed").count().collect()} == {3}
    assert {(r.p, r.seed, r.k) for r in swaps.collect()} == {(p, s, 2) for p in ("2", "inf") for s in (42, 43)}
    assert set(sets.columns) >= {"k", "slot", "id"} and analysis.final_prototypes(sets).count() > 0


def test_chunks_of_coordinates(spark, clustered):
    pts = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(clustered)], "id long, features array<double>").repartition(5)
    chunks = prep.transpose_chunks(pts, cells=21)
    assert chunks.agg(F.max(F.size("features"))).first()[0] <= 7
    whole = {r.id: r.features for r in prep.transpose(pts).collect()}
    assert np.allclose([whole[j] for j in range(3)], clustered.T)
    by_id = {r.id: r.distances for r in prep.chunk_distances(chunks, [2, 0]).collect()}
    assert np.allclose([by_id[j] for j in range(3)], kernels.distances(clustered.T, clustered.T[[2, 0]]))
    by_id = {r.id: r.products for r in prep.chunk_products(chunks, [1]).collect()}
    assert np.allclose([by_id[j] for j in range(3)], clustered.T @ clustered.T[[1]].T)
    assert prep.transpose(pts.limit(0)).count() == 0


def test_extra_columns_of_any_name(spark):
    pts = points(spark, RNG.normal(size=(10, 2))).withColumn("a.b", F.lit(1)).withColumn("_0", F.lit("x"))
    rows = energies.assign(pts, pairs.prototypes(pts, [1]), "cluster").collect()
    assert {(r["a.b"], r["_0"]) for r in rows} == {(1, "x")} and rows[0].asDict().keys() == {"id", "features", "a.b", "_0", "dist"}


@pytest.mark.parametrize("p", [2, None])
def test_optimal_curve_of_many_coordinates(spark, monkeypatch, p):
    x = RNG.normal(size=(60, 25)) * np.linspace(3, 0.1, 25)
    want = [r.bound for r in energies.optimal_lowrank_curve(points(spark, x), 4, p).orderBy("k").collect()]
    monkeypatch.setattr(energies, "MOST_COORDINATES", 20)
    got = [r.bound for r in energies.optimal_lowrank_curve(points(spark, x), 4, p).orderBy("k").collect()]
    assert got == pytest.approx(want, rel=1e-7) and len(got) == 5
    with pytest.raises(ValueError, match="too many"):
        energies.optimal_lowrank_curve(points(spark, x), 4, 1)
    # As many values as there are coordinates, equal ones and zeros among them.
    few = np.diag([2.0, 2.0, 1.0, 0.0])
    assert energies.leading_squares(points(spark, few), 9) == pytest.approx([4, 4, 1, 0], abs=1e-9)


@pytest.mark.parametrize("p", [1, 2, 5, None])
@pytest.mark.parametrize("name", ["convex", "conic"])
def test_beside_one_point_no_search(monkeypatch, name, p):
    """Candidates beside one other point: closed forms, where rows lie on, past or behind what the two span."""
    e, rng = energies.of(name), np.random.default_rng(4)
    x = np.abs(rng.normal(size=(60, 5))) if name == "conic" else rng.normal(size=(60, 5))
    x[1], x[2], x[3], x[4] = x[0], 0, 3 * x[5], (x[0] + x[5]) / 2
    want = {swap: [[whole(e.distance(np.vstack([r, one]), x), p) for r in rest] for one in x] for swap, rest in ((False, x[[0]]), (True, x[[7, 0]]))}
    met, plain = [], kernels.constrained
    monkeypatch.setattr(kernels, "constrained", lambda x, *a: met.append(len(x)) or plain(x, *a))
    for swap, s in ((False, x[[0]]), (True, x[[0, 7]])):
        got = e.move_parts(s, x, x, p, swap)
        assert np.allclose(got if p is None else got ** (1 / p), want[swap], rtol=1e-9, atol=1e-9)
    # Only candidates on the point's own ray (a few copies) need the search.
    assert sum(met) <= 20 * len(x)


def test_beside_one_point_where_all_is_near(monkeypatch):
    """Sums that nearly vanish come from differences."""
    rng = np.random.default_rng(5)
    for name in ("convex", "conic"):
        e, ends = energies.of(name), 100 + np.abs(rng.normal(size=(2, 4)))
        share = rng.uniform(0.2, 0.8, size=(50, 1))
        x = share * ends[0] + (1 - share) * ends[1] + 1e-9 * rng.normal(size=(50, 4))
        got = e.move_parts(ends[[0]], x, ends[[1]], 2, False)[0, 0] ** 0.5
        assert got == pytest.approx(whole(e.distance(ends, x), 2), abs=1e-11) and got < 1e-7


@pytest.mark.parametrize("p", [1, 2, 5.0, 3, None])
@pytest.mark.parametrize("swapped", [False, True])
def test_bounds_of_moves(p, swapped):
    e, rng = energies.of("cluster"), np.random.default_rng(6)
    for shift, size in ((0, 1), (100, 1), (0, 1e-9), (3, 1e9)):
        x = (rng.normal(size=(600, 24)) + shift) * size
        x[:20] = x[20:40]
        for s in (x[[0, 30, 100]], x[:1], x[:0])[: 2 if swapped else 3]:
            exact, least = (f(s, x, x, p, swapped) for f in (e.move_parts, e.least_parts))
            assert (least <= exact * (1 + 1e-12)).all() and (least >= exact * (1 - 1e-3)).all()


def scored(monkeypatch):
    """Rows that go out to be scored exactly, and from below."""
    met, plain = {False: 0, True: 0}, scores.moved

    def moved(pts, cands, s, e, p, swapped, least=False):
        met[least] += cands.count()
        return plain(pts, cands, s, e, p, swapped, least)

    monkeypatch.setattr(scores, "moved", moved)
    monkeypatch.setattr(swap, "moved", moved)
    return met


@pytest.mark.parametrize("p", [2, 5.0])
def test_a_search_build_scores_few_rows_exactly(spark, monkeypatch, p):
    x = np.random.default_rng(7).normal(size=(400, 6))
    x[350:] = x[:50]  # copies tie
    monkeypatch.setattr(scores, "FEW", 50)
    met, pts = scored(monkeypatch), points(spark, x)
    got = build.build_search(pts, 3, "cluster", p)
    d, near = kernels.distances(x, x), np.full(400, np.inf)
    for (_, i, _, value), one in zip(got.log, got.chosen.x, strict=True):
        each = (np.minimum(d, near[:, None]) ** p).sum(axis=0) ** (1 / p)
        assert value == pytest.approx(each.min(), rel=1e-12) and value == pytest.approx(each[i], rel=1e-12) and (x[i] == one).all()
        near = np.minimum(near, d[:, i])
    assert met[False] <= 3 * 3 * scores.FIRST and met[True] >= (2 if p == 2 else 3) * 390


@pytest.mark.parametrize("p", [2, None])
def test_a_search_swap_scores_few_rows_exactly(spark, monkeypatch, p):
    x = np.random.default_rng(8).normal(size=(500, 6))
    pts, runs = points(spark, x), []
    for few in (10**9, 0):
        monkeypatch.setattr(scores, "FEW", few)
        with monkeypatch.context() as m:
            met = scored(m)
            got = swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), "cluster", p, first_chunk=64)
        runs.append((got.chosen.ids, [(a, c) for a, _, _, c in got.log], [b for _, _, b, _ in got.log], met))
    assert runs[0][:2] == runs[1][:2] and len(runs[0][1]) > 2
    assert runs[0][2] == pytest.approx(runs[1][2], rel=1e-12)
    assert runs[0][3][True] == 0 and runs[1][3][False] < runs[0][3][False] / 2


def test_rows_of_one_part_are_dealt_out(spark):
    one = spark.range(10).select("id", F.array(F.lit(1.0)).alias("features")).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert scores.dealt(one, 10**7).rdd.getNumPartitions() >= max(cores, 10**7 // scores.MOST_ROWS)
