"""Builds and swaps on small tables, against plain loops, and the same on any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospan.operators import analysis, build, energies, experiment, pairs, prep, scores, swap
from protospan.sources import generators, results
from protospan.sources.points import complex_points, read_points
from protospan.streaming.assign import assign_stream


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(60, 4))) + np.repeat(np.eye(4)[:3] * 3, 20, axis=0)
    rows = [(i, [float(v) for v in r], i // 20) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").persist()


def x_of(pts):
    return np.array([r.features for r in pts.orderBy("id").collect()])


@pytest.mark.parametrize("p", [1, 2, 5, None])
@pytest.mark.parametrize("name", ["cluster", "lowrank"])
def test_values_of_moves(pts, name, p):
    x, e, chosen = x_of(pts), energies.of(name), pairs.prototypes(pts, [3, 30])
    whole = lambda d: d.max() if p is None else (d**p).sum() ** (1 / p)
    for r in scores.search_values(pts, chosen, name, p).collect():
        s = chosen.x if r.id in chosen.ids else np.vstack([chosen.x, x[r.id]])
        assert r.value == pytest.approx(whole(e.distance(s, x)), rel=1e-8)
    got = scores.swap_values(pts, chosen, name, p).collect()
    assert len(got) == 58 * 2
    for r in got:
        s = chosen.x.copy()
        s[r.slot] = x[r.id]
        assert r.value == pytest.approx(whole(e.distance(s, x)), rel=1e-8)


@pytest.mark.parametrize("name,p", [("cluster", 2), ("cluster", None), ("lowrank", 2), ("lowrank", 1)])
def test_search_swap_is_the_sequential_scan(pts, name, p):
    x, e = x_of(pts), energies.of(name)
    whole = lambda s: (lambda d: d.max() if p is None else (d**p).sum() ** (1 / p))(e.distance(s, x))
    ids, n = [0, 1, 2], len(x)
    now, cursor, still, trace = whole(x[ids]), 0, 0, []
    while still < n:
        j = cursor % n
        cursor += 1
        if j not in ids:
            values = [whole(np.vstack([np.delete(x[ids], t, 0)[:t], x[j][None], np.delete(x[ids], t, 0)[t:]])) for t in range(3)]
            t = int(np.argmin(values))
            if values[t] < now and not swap.close(values[t], now):
                ids[t], now = j, values[t]
                trace.append((now, still))
                still = 0
                continue
        still += 1
    got = swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), name, p, first_chunk=7)
    assert got.chosen.ids == ids
    assert [(pytest.approx(r[2]), r[3]) for r in got.log[:-1]] == trace
    assert got.log[-1][3] == n


def test_partitioning_does_not_matter(pts):
    for name, method in (("cluster", "sampling"), ("lowrank", "search"), ("conic", "sampling")):
        found = {tuple(build.BUILDS[method](pts.repartition(n), 3, name, 2, 7).chosen.ids) for n in (1, 4, 13)}
        assert len(found) == 1


def test_builds_go_down_and_swaps_do_not_lose(pts):
    for name in ("cluster", "lowrank", "conic", "convex"):
        ready = energies.of(name).prepare(pts)
        for method in ("uniform", "sampling"):
            got = build.BUILDS[method](ready, 4, name, 2)
            e = [r[3] for r in got.log]
            assert all(a >= b - 1e-6 for a, b in zip(e[1:], e[2:], strict=False))
        assert got.chosen.ids == [r[1] for r in got.log]
        better = swap.swap_sampling(ready, got.chosen, name, 2)
        assert better.energy <= e[-1] + 1e-9


def test_all_rows_alike(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, features array<double>")
    got = build.build_sampling(same, 3, "cluster", 2)
    assert len(got.chosen) == 1 and got.energy == 0
    assert len(build.build_sampling(same.limit(0), 3, "cluster", 2).chosen) == 0


def test_draws_follow_weights(spark):
    n = 4000
    rows = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(d).alias("d")) for i, d in enumerate([1.0, 2.0, 0.0, 3.0])])).alias("r"), F.col("id").alias("trial"))
    from protospan.functions.vectors import uniform

    race = F.log(-F.log(uniform(1, F.col("trial").cast("string"), "r.id"))) - 2 * F.log("r.d")
    won = rows.filter("r.d > 0").groupBy("trial").agg(F.min_by("r.id", race).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / n for r in won}
    assert share[0] == pytest.approx(1 / 14, abs=0.02) and share[1] == pytest.approx(4 / 14, abs=0.03) and 2 not in share


def test_worst_case_sampling(pts):
    x = x_of(pts)
    got = build.build_sampling(pts, 3, "cluster", None)
    for t in (1, 2):
        d = energies.of("cluster").distance(x[got.chosen.ids[:t]], x)
        assert d[got.chosen.ids[t]] == pytest.approx(d.max())
    assert swap.swap_sampling(pts, got.chosen, "cluster", None).energy <= got.energy + 1e-9


def test_conic_refuses_negative_points(spark):
    bad = spark.createDataFrame([(0, [1.0, -1.0])], "id long, features array<double>")
    with pytest.raises(ValueError):
        energies.of("conic").prepare(bad)


def test_preparation(spark, pts):
    holes = spark.createDataFrame([(0, [1.0, None]), (1, [3.0, float("nan")]), (2, [None, 5.0])], "id long, features array<double>")
    assert [r.features for r in prep.impute_mean(holes).orderBy("id").collect()] == [[1, 5], [3, 5], [2, 5]]
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, features array<double>")
    assert [r.features for r in prep.l2_normalize(zero).orderBy("id").collect()] == [[0, 0], [0.6, 0.8]]
    assert prep.l2_normalize(zero, "drop").count() == 1
    cube = spark.createDataFrame([([[[1.0], [2.0]], [[3.0], [4.0]]], [[0, 1], [2, 3]])], "features array<array<array<double>>>, labels array<array<int>>")
    assert [(r.id, r.features, r.label) for r in prep.flatten_cube(cube).orderBy("id").collect()] == [(0, [1], 0), (1, [2], 1), (2, [3], 2), (3, [4], 3)]
    assert [r.position for r in prep.with_position(pts.filter("id % 3 = 1")).orderBy("id").collect()] == list(range(20))
    far = [*range(50), -(2**63), 2**63 - 1]
    wide = spark.createDataFrame([(i,) for i in far], "id long").repartition(3)
    assert [r.id for r in prep.with_position(wide).orderBy("position").collect()] == sorted(far)
    assert prep.with_position(wide.limit(0)).count() == 0
    assert np.allclose(np.array([r.features for r in prep.transpose(pts).orderBy("id").collect()]), x_of(pts).T)
    assert np.allclose(x_of(prep.center(pts)).mean(axis=0), 0)
    assert prep.sample_per_label(pts, 4).groupBy("label").count().filter("count = 4").count() == 3
    assert dict(prep.to_float(pts).dtypes)["features"] == "array<float>"
    with pytest.raises(Exception):
        pairs.distances_to(holes, pairs.Prototypes([0], np.zeros((1, 2)))).collect()


def test_knn(pts):
    x = x_of(pts)
    got = {}
    for r in pairs.knn_join(pts, 3, blocks=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == list(np.argsort(d[i], kind="stable")[:3]) for i in range(len(x)))


def test_complex_points(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(20, 3)) + 1j * rng.normal(size=(20, 3))
    raw = spark.createDataFrame([(i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(z)], "k long, a array<double>, b array<double>")
    pts = complex_points(raw, "k", "a", "b")
    got = build.build_search(pts, 2, "lowrank", 2)
    best = [np.sqrt((energies.of("lowrank").distance(z[[i]], z) ** 2).sum()) for i in range(20)]
    assert got.chosen.ids[0] == int(np.argmin(best))
    rows = energies.assign(pts, got.chosen, "lowrank", weights=True).orderBy("id").collect()
    w = np.array([r.weights for r in rows]) + 1j * np.array([r.weights_im for r in rows])
    assert np.allclose(np.linalg.norm(z - w @ got.chosen.x, axis=1), [r.dist for r in rows])
    assert len(swap.swap_sampling(pts, got.chosen, "lowrank", 2).chosen) == 2
    made = energies.reconstruct(pts, got.chosen, "lowrank").orderBy("id").collect()
    assert np.allclose([np.array(r.recon) + 1j * np.array(r.recon_im) for r in made], w @ got.chosen.x)
    error = [r.error for r in energies.reconstruction_error(pts, got.chosen, "lowrank").orderBy("id").collect()]
    assert np.allclose(error, np.array([r.dist for r in rows]) / 3)


def test_the_only_prototype_left_out(pts):
    state = energies.cluster_assign2(pts, pairs.prototypes(pts, [3]))
    by_state = {r.dist for r in energies.cluster_leave_one_out(state, 0).collect()}
    assert by_state == {r.left_out[0] for r in energies.leave_one_out(pts, pairs.prototypes(pts, [3]), "cluster").collect()} == {1.0}


def test_states_before_the_first_prototype(pts):
    x = x_of(pts)
    assert {r.dist for r in energies.initial_state(pts, "cluster").collect()} == {1.0}
    got = [r.dist for r in energies.initial_state(pts, "lowrank").orderBy("id").collect()]
    assert np.allclose(got, np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("p", [1, 2, 5, None])
def test_no_prototypes_beat_the_optimal_curve(pts, p):
    x = x_of(pts)
    values = np.linalg.svd(x, compute_uv=False)
    bound = {r.k: r.bound for r in energies.optimal_lowrank_curve(pts, 4, p).collect()}
    for k in range(5):
        rest = values[k:]
        want = rest.max(initial=0) if p is None else (rest**p).sum() ** (1 / p) / len(x) ** (1 / p)
        assert bound[k] == pytest.approx(want, abs=1e-6)
    if p == 2:
        got = [build.build_search(pts, k, "lowrank", 2).energy / len(x) ** 0.5 for k in (1, 2)]
        assert got[0] >= bound[1] and got[1] >= bound[2]


def test_rows_by_label(spark):
    rows = spark.createDataFrame([(3, [1.0], 2), (1, [2.0], 2), (2, [3.0], None), (5, [4.0], 1)], "id long, features array<double>, label int")
    assert [r.id for r in prep.sort_by_label(rows).collect()] == [2, 5, 1, 3]


def test_user_energy(pts):
    class Manhattan(energies.Cluster):
        name = "manhattan"

        def nearest(self, s, x):
            d = np.abs(x[:, None] - s[None]).sum(axis=2)
            near = d.argmin(axis=1)
            return near, d[np.arange(len(x)), near], near, d[np.arange(len(x)), near]

        without = energies.Energy.without
        after_add = energies.Energy.after_add
        after_swap = energies.Energy.after_swap

    x, e = x_of(pts), Manhattan()
    got = build.build_sampling(pts, 3, e, 1)
    far = lambda s: np.abs(x[:, None] - s[None]).sum(axis=2).min(axis=1).sum()
    assert len(got.chosen) == 3 and got.energy == pytest.approx(far(got.chosen.x))
    searched = build.build_search(pts, 2, e, 1)
    assert searched.chosen.ids[0] == min(range(len(x)), key=lambda i: far(x[[i]]))
    better = swap.swap_search(pts, got.chosen, e, 1)
    assert better.energy == pytest.approx(far(better.chosen.x)) and better.energy <= got.energy
    least = min(far(np.vstack([np.delete(better.chosen.x, t, 0), x[i]])) for t in range(3) for i in range(len(x)))
    assert better.energy <= least * (1 + 1e-5)


def test_grid_resumes(spark, pts, tmp_path):
    plan = experiment.grid(spark, "t", "cluster", ["sampling", "search", "sampling_search"], [2], 2, 2, 3, ("search",))
    assert {(r.method, r.seed, r.k) for r in plan.collect()} == {("sampling", 42, 2), ("sampling", 43, 2), ("search", 42, 3), ("sampling_search", 42, 2)}
    steps, swaps, protos = experiment.run_grid(pts, plan.filter("method != 'search'"), str(tmp_path / "g"))
    results.write_results(protos, str(tmp_path / "p"))
    results.write_results(protos, str(tmp_path / "p"))
    stored = results.read_results(spark, str(tmp_path / "p"))
    assert stored.count() == protos.count()
    assert [r.method for r in experiment.pending_runs(plan, stored).collect()] == ["search"]
    assert experiment.pending_runs(plan, stored, ("sampling",)).count() == 3
    assert {r.method for r in experiment.finished_methods(stored, 2).collect()} == {"sampling", "sampling_search"}
    assert analysis.energy_by_k(steps, swaps, 60, 2).count() >= 3
    sets = analysis.reconstructions(protos, pts, "lowrank", [1, 2], "sampling_search")
    assert sets.count() == 4 and sets.select("id").distinct().count() == 1
    whole = {m: [r.id for r in protos.filter(F.col("method") == m).filter("seed = 42 and k = 2").orderBy("slot").collect()] for m in ("sampling", "sampling_search")}
    for r in sets.collect():
        s = x_of(pts)[whole[r.method][: r.k]]
        row = x_of(pts)[r.id]
        assert np.allclose(r.recon, row @ np.linalg.pinv(s) @ s) and r.error == pytest.approx(np.linalg.norm(row - r.recon) / 4)
    labels = {(r.method, r.slot): (r.id, r.label) for r in analysis.prototype_labels(protos.filter("k = 2"), pts, 2).collect()}
    assert len(labels) == 4 and all(label == i // 20 for i, label in labels.values())
    built = stored.filter("method = 'sampling' and seed = 42").select("slot", "id")
    assert {r.k for r in experiment.swap_prefixes(pts, built, "sampling_search", "cluster", 2).collect()} == {1, 2}


def test_generators(spark):
    assert generators.make_blobs(spark, [10, 5], 3, 0.1).groupBy("label").count().count() == 2
    z = np.array([v for r in generators.make_gaussian(spark, 200, 10).collect() for v in r.features])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1
    m = np.array([r.features for r in generators.make_mixture(spark, 30, 20).collect()])
    assert (m >= 0).all() and m.max() > 0
    f = np.array([r.features for r in generators.make_smile(spark, 1000).collect()])
    assert np.isclose(np.linalg.norm(f, axis=1), 10).sum() >= 800
    assert generators.make_outliers(spark, 200, 5).filter(F.array_max(F.transform("features", F.abs)) > 50).count() == 5
    assert len(generators.make_robspiral(spark, 10).orderBy("id").first().features) == 2


def test_stream_and_files(spark, pts, tmp_path):
    pts.write.parquet(str(tmp_path / "in"))
    chosen = pairs.prototypes(pts, [0, 25, 50])
    stream = assign_stream(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), chosen)
    q = stream.writeStream.format("memory").queryName("assigned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    want = {r.id: r.near_slot for r in energies.cluster_assign(pts, chosen).collect()}
    assert {r.id: r.near_slot for r in spark.table("assigned").collect()} == want
    pts.select("id", F.to_json("features").alias("v"), "label").write.option("header", True).csv(str(tmp_path / "csv"))
    back = read_points(spark, str(tmp_path / "csv"), "id", "v", "label", "csv")
    assert np.allclose(x_of(back), x_of(pts))
