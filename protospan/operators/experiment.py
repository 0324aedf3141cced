"""Grids of runs: methods x powers x seeds, resumed where they stopped.

A method is a build ("sampling") or a build and a swap ("search_search"). A method whose name ends in
``search`` is the same for every seed and runs for the first one alone.

``run_grid`` keeps its results in a folder: a run is one row, in a partition of its own, that is written when the
run is done. So a grid that was stopped goes on with the runs that are not there, and swaps read the builds back.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions.ship import ship
from protospan.functions.tables import shared_folder
from protospan.operators.build import BUILDS, Build, init_set
from protospan.operators.energies import Energy, of
from protospan.operators.pairs import Prototypes, prototypes
from protospan.operators.prep import with_position
from protospan.operators.scores import dealt
from protospan.operators.swap import SWAPS, Swap
from protospan.sources.results import RUN, read_results, write_results

#: The standard grid.
METHODS = ["search", "sampling", "uniform", "search_search", "sampling_sampling"]
POWERS = [1, 2, 5, None]
FIRST_SEED = 42

KEYS = "dataset string, energy string, p string, method string, seed int, k int"
BUILD_STEPS = KEYS + ", step int, id long, seconds double, energy_value double"
SWAP_STEPS = KEYS + ", swap_no int, seconds double, energy_value double, stagnation long"
PROTOTYPES = KEYS + ", slot int, id long"
RUNS = KEYS + (
    ", done_ts timestamp, build array<struct<step:int,id:long,seconds:double,energy_value:double>>, "
    "swaps array<struct<k:int,swap_no:int,seconds:double,energy_value:double,stagnation:long>>, sets array<struct<k:int,slot:int,id:long>>"
)


def power_name(p: float | None) -> str:
    return "inf" if p is None else f"{p:g}"


@dataclass
class Run:
    build: Build
    swap: Swap | None = None

    @property
    def chosen(self) -> Prototypes:
        return self.swap.chosen if self.swap else self.build.chosen

    @property
    def energy(self) -> float:
        return self.swap.energy if self.swap else self.build.energy


def run_method(pts: DataFrame, method: str, energy: str | Energy = "cluster", p: float | None = 2, k: int = 10, seed: int = FIRST_SEED, max_swaps: int = -1) -> Run:
    """``pts`` should be prepared and persisted."""
    build, _, swap = method.partition("_")
    out = Run(BUILDS[build](pts, k, energy, p, seed))
    if swap and len(out.build.chosen):
        more = {"max_swaps": max_swaps} if swap == "search" else {}
        out.swap = SWAPS[swap](pts, out.build.chosen, energy, p, seed, **more)
    return out


def grid(spark: SparkSession, dataset: str, energy: str, methods=METHODS, powers=POWERS, seeds: int = 1, k: int = 10, k_oversample: int | None = None, oversample: tuple[str, ...] = ()) -> DataFrame:
    """Planned runs. Builds named in ``oversample`` choose ``k_oversample`` rows."""
    rows = [(dataset, energy, power_name(p), m, s) for m in methods for p in powers for s in range(FIRST_SEED, FIRST_SEED + seeds)]
    table = spark.createDataFrame(rows, "dataset string, energy string, p string, method string, seed int")
    size = F.when(F.col("method").isin(list(oversample)), k_oversample or k).otherwise(k)
    return deterministic_once(table).withColumn("k", size.cast("int"))


def deterministic_once(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("method").endswith("search") | (F.col("seed") == FIRST_SEED))


def pending_runs(table: DataFrame, done: DataFrame, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Planned runs that are not done; methods in ``overwrite`` count as not done."""
    kept = done.filter(~F.col("method").isin(list(overwrite))) if overwrite else done
    return table.join(kept.select(*RUN).distinct(), RUN, "left_anti")


def finished_methods(done: DataFrame, seeds: int) -> DataFrame:
    """dataset, energy, p and method of those with all their seeds (one for methods that end in ``search``)."""
    need = F.when(F.col("method").endswith("search"), 1).otherwise(seeds)
    got = done.groupBy("dataset", "energy", "p", "method").agg(F.countDistinct("seed").alias("seeds"))
    return got.filter(F.col("seeds") >= need).drop("seeds")


def _swapped(pts: DataFrame, built: Prototypes, swap: str, energy: str | Energy, p: float | None, seed: int, ks: list[int], rows: DataFrame | None = None) -> Iterator[tuple[int, Swap]]:
    """Swaps from prefixes of a build. The prototypes are fetched once, and so are the rows' positions.

    With one prototype there is no search swap, as the best single row is known from the build: its set stays.
    """
    energies = init_set(pts, Prototypes(built.ids[:1], built.x[:1]), energy, p) if swap == "search" and 1 in ks else []
    more = {} if rows is None or swap != "search" else {"rows": rows}
    for k in ks:
        first = Prototypes(built.ids[:k], built.x[:k])
        if k == 1 and swap == "search":
            yield k, Swap(first, energies[0], [(1, 0.0, energies[0], 0)])
        else:
            yield k, SWAPS[swap](pts, first, energy, p, seed, **more)


def run_grid(pts: DataFrame, table: DataFrame, path: str, overwrite: tuple[str, ...] = (), prefixes: bool = True, together: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Do the runs of a grid that ``path`` does not hold yet, builds first; the steps and sets of all runs it holds then.

    A swap starts from the stored build of its energy, power and seed (its first k rows, if it was oversampled), or
    makes that build first, and swaps every prefix of it, or with ``prefixes=False`` the whole of it alone. Methods
    in ``overwrite`` are done again. A run is a chain of Spark jobs over the shared points; as these are many and short, so many runs go on
    ``together`` (1, where the seconds of their steps should not hold what they wait for each other). They are stored in order.
    """
    spark = pts.sparkSession
    done = stored_runs(spark, path)
    todo = table if done is None else pending_runs(table, done, overwrite)
    builds: dict[tuple, list[int]] = {}
    if done is not None:
        kept = done.filter(~F.col("method").contains("_") & ~F.col("method").isin(list(overwrite)))
        # As many ids as all builds of the grid choose.
        builds = {(r.dataset, r.energy, r.p, r.method, r.seed): r.ids for r in kept.select(*RUN, F.transform("build", lambda b: b["id"]).alias("ids")).collect()}
    ready: dict[str, DataFrame] = {}
    placed: dict[str, DataFrame] = {}  # with positions, for search swaps
    runs = todo.orderBy(F.col("method").contains("_"), "method", "p", "seed").collect()  # as many rows as runs
    for r in runs:
        if r.energy not in ready:
            prepared = of(r.energy).prepare(pts)
            ready[r.energy] = dealt(prepared, prepared.count()).persist()
        if r.method.endswith("_search") and r.energy not in placed:
            placed[r.energy] = with_position(ready[r.energy]).persist()
    made: dict[tuple, Future] = {}

    def key(r) -> tuple:
        return r.dataset, r.energy, r.p, r.method.partition("_")[0], r.seed

    def power(r) -> float | None:
        return None if r.p == "inf" else float(r.p)

    def done_run(r) -> tuple:
        x, swap = ready[r.energy], r.method.partition("_")[2]
        got = made[key(r)].result() if key(r) in made else None
        ids = (got.chosen.ids if got else builds[key(r)])[: r.k]
        steps, sets, moves = [], [], []
        if swap:
            ks = list(range(1, len(ids) + 1)) if prefixes else [len(ids)] if ids else []
            for k, better in _swapped(x, prototypes(x, ids), swap, r.energy, power(r), r.seed, ks, placed.get(r.energy)):
                moves += [(k, *row) for row in better.log]
                sets += [(k, slot, i) for slot, i in enumerate(better.chosen.ids)]
        else:
            steps = [tuple(b) for b in got.log[: r.k]]
            sets = [(len(ids), slot, i) for slot, i in enumerate(ids)]
        return r.dataset, r.energy, r.p, r.method, r.seed, r.k, datetime.datetime.now(datetime.timezone.utc), steps, moves, sets

    ship(spark)
    shared_folder(spark)
    pool = ThreadPoolExecutor(together)
    try:
        # Builds that runs are or start from, each once and as long as any of them needs, before all swaps.
        need = {key(r): max(o.k for o in runs if key(o) == key(r)) for r in runs}
        for r in runs:
            if key(r) not in made and ("_" not in r.method or len(builds.get(key(r), [])) < need[key(r)]):
                made[key(r)] = pool.submit(BUILDS[key(r)[3]], ready[r.energy], need[key(r)], r.energy, power(r), r.seed)
        for row in pool.map(done_run, runs):
            write_results(spark.createDataFrame([row], RUNS), path)
    finally:
        pool.shutdown(cancel_futures=True)
    for df in [*ready.values(), *placed.values()]:
        df.unpersist()
    return run_tables(stored_runs(spark, path), spark)


def stored_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The runs that ``path`` holds: their keys, k, done_ts and steps; None if there is none yet."""
    try:
        found = read_results(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found


def run_tables(runs: DataFrame | None, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """build_steps, swap_steps and prototypes of stored runs."""
    if runs is None:
        return tuple(spark.createDataFrame([], x) for x in (BUILD_STEPS, SWAP_STEPS, PROTOTYPES))
    keys = [F.col(c) for c in RUN]

    def spread(column: str, names: list[str], own_k: bool) -> DataFrame:
        each = runs.select(*keys, "k", F.explode(column).alias("r"))
        return each.select(*keys, *([] if own_k else [F.col("k")]), *[F.col(f"r.{n}").alias(m) for n, m in names])

    moves = [("k", "k"), ("swap_no", "swap_no"), ("seconds", "seconds"), ("energy_value", "energy_value"), ("stagnation", "stagnation")]
    return (
        spread("build", [(n, n) for n in ("step", "id", "seconds", "energy_value")], False),
        spread("swaps", moves, True),
        spread("sets", [(n, n) for n in ("k", "slot", "id")], True),
    )


def swap_prefixes(pts: DataFrame, built: DataFrame, method: str, energy: str | Energy, p: float | None, seed: int = FIRST_SEED, kmax: int | None = None) -> DataFrame:
    """swap_steps from every prefix of a stored build (slot, id); a single prototype stays as it is in a search swap."""
    spark = pts.sparkSession
    ids = [r.id for r in built.orderBy("slot").collect()]  # k rows
    swap, name = method.partition("_")[2], energy if isinstance(energy, str) else energy.name
    ks = list(range(1, min(kmax or len(ids), len(ids)) + 1))
    found = _swapped(pts, prototypes(pts, ids[: max(ks, default=0)]), swap, energy, p, seed, ks)
    rows = [("", name, power_name(p), method, seed, k, no, sec, e, st) for k, done in found for no, sec, e, st in done.log]
    return spark.createDataFrame(rows, SWAP_STEPS)
