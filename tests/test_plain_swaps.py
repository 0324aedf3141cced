"""Swaps against plain loops over NumPy arrays, with the same random numbers."""

import hashlib
import math

import numpy as np
import pytest

from protospan.operators import energies, pairs, swap

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def x():
    return np.abs(RNG.normal(size=(50, 4))) + np.repeat(np.eye(4)[:2] * 4, 25, axis=0)


@pytest.fixture(scope="module")
def pts(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3).persist()


def uniform(seed, step, i):
    return (int(hashlib.md5(f"{seed}:{step}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)


def whole(d, p):
    return d.max() if p is None else (d**p).sum() ** (1 / p)


def won(d, p, seed, step, but=None):
    """The row that a draw in proportion to d^p gives."""
    best = (math.inf, None)
    for i, v in enumerate(d):
        if i == but or v <= 0 or (p is None and v < d.max()):
            continue
        best = min(best, (math.log(-math.log(uniform(seed, step, i))) - (0 if p is None else p * math.log(v)), i))
    return best[1]


def first_to_move(stay, seed, step):
    q = [math.prod(stay[:j]) * (1 - stay[j]) for j in range(len(stay))]
    return int(np.random.default_rng([seed, step]).choice(len(q), p=np.array(q) / sum(q)))


def plain_sampling(x, ids, e, p, seed):
    k, ids = len(ids), list(ids)
    now = whole(e.distance(x[ids], x), p)
    best, log = (now, list(ids)), []
    slot = step = swaps = 0
    stays, slots = [], []
    while swaps < 2 * k:
        d = e.distance(x[[i for t, i in enumerate(ids) if t != slot]], x)
        weight = (d == d.max()).astype(float) if p is None else d**p
        new = won(d, p, seed, f"s{step}")
        step += 1
        tried = len(stays)
        if new == ids[slot]:
            stays.append(weight[new] / weight.sum())
            slots.append(slot)
            slot = (slot + 1) % k
            if len(stays) < k:
                continue
            if p is None or np.isclose(math.prod(stays), 1):
                break
            slot = slots[first_to_move(stays, seed, step)]
            d = e.distance(x[[i for t, i in enumerate(ids) if t != slot]], x)
            new, tried = won(d, p, seed, f"s{step}", ids[slot]), k
            step += 1
            if new is None:
                break
        ids[slot] = new
        swaps += 1
        now = whole(e.distance(x[ids], x), p)
        log.append((now, tried))
        stays, slots, slot = [], [], (slot + 1) % k
        if now < best[0]:
            best = (now, list(ids))
    return best, log, now, len(stays)


def plain_lowrank(x, ids, p, seed):
    e, k, ids, power = energies.of("lowrank"), len(ids), list(ids), 1 if p is None else p
    now = whole(e.distance(x[ids], x), p)
    best, log, slot, swaps = (now, list(ids)), [], 0, 0
    while swaps < 2 * k:
        order = [(slot + t) % k for t in range(k)]
        left = {t: e.distance(np.delete(x[ids], t, axis=0), x) for t in order}
        stays = [left[t][ids[t]] ** power / (left[t] ** power).sum() for t in order]
        if np.isclose(math.prod(stays), 1):
            break
        at = first_to_move(stays, seed, swaps)
        slot = order[at]
        ids[slot] = won(left[slot], power, seed, f"l{swaps}", ids[slot])
        swaps += 1
        now = whole(e.distance(x[ids], x), p)
        log.append((now, at))
        slot = (slot + 1) % k
        if now < best[0]:
            best = (now, list(ids))
    return best, log, now


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("p", [1, 2, None])
@pytest.mark.parametrize("name", ["cluster", "conic"])
def test_sampling(pts, x, name, p, seed):
    e = energies.of(name)
    (energy, ids), log, last, vain = plain_sampling(x, [0, 1, 2], e, p, seed)
    got = swap.swap_sampling(pts, pairs.prototypes(pts, [0, 1, 2]), name, p, seed)
    assert got.chosen.ids == ids and got.energy == pytest.approx(energy)
    assert [(pytest.approx(r[2]), r[3]) for r in got.log] == [*log, (last, vain)]


def test_forced_swaps_happen(spark):
    """Where few rows lie far from the others, trivial draws are common, and slots are forced to move."""
    x, forced = np.array([[0.0, 0], [0.5, 0.1], [0.1, 0.4], [12, 1], [1, 13]]), 0
    few = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").coalesce(1).persist()
    for seed in range(3):
        (energy, ids), log, last, vain = plain_sampling(x, [3, 0, 4], energies.of("cluster"), 2, seed)
        got = swap.swap_sampling(few, pairs.prototypes(few, [3, 0, 4]), "cluster", 2, seed)
        assert got.chosen.ids == ids and [r[3] for r in got.log] == [*(n for _, n in log), vain] and got.log[-1][2] == pytest.approx(last)
        forced += sum(n == 3 for _, n in log)
    assert forced > 0


@pytest.mark.parametrize("p", [1, 2, None])
def test_sampling_lowrank(pts, x, p):
    (energy, ids), log, last = plain_lowrank(x, [0, 1, 2], p, 3)
    got = swap.swap_sampling(pts, pairs.prototypes(pts, [0, 1, 2]), "lowrank", p, 3)
    assert got.chosen.ids == ids and got.energy == pytest.approx(energy)
    assert [(pytest.approx(r[2]), r[3]) for r in got.log] == [*log, (last, 0)]
