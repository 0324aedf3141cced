"""Tables that compare methods, from build_steps and swap_steps of one dataset, energy and power."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protospan.operators.energies import Energy, exemplar_nearest_mean_error, normalized_energy, reconstruction_error
from protospan.operators.pairs import lookup_points, prototypes

RUN = ["method", "seed"]


def _so_far(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative_time(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    return steps.withColumn("total_seconds", F.sum("seconds").over(_so_far(by, order)))


def running_minimum(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    return steps.withColumn("best", F.min("energy_value").over(_so_far(by, order)))


def monotone(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rises``: whether a step's energy is above the one before it."""
    before = F.lag("energy_value").over(Window.partitionBy(*by).orderBy(order))
    return steps.withColumn("rises", F.coalesce(F.col("energy_value") > before, F.lit(False)))


def energy_by_k(build_steps: DataFrame, swap_steps: DataFrame, n: int, p: float | None) -> DataFrame:
    """method, k and energy: the build's value with k prototypes, or the swap's last from k, per row, averaged over seeds."""
    built = build_steps.filter(~F.col("method").contains("_")).select(*RUN, (F.col("step") + 1).alias("k"), "energy_value")
    swapped = swap_steps.groupBy(*RUN, "k").agg(F.max_by("energy_value", "swap_no").alias("energy_value"))
    rows = built.unionByName(swapped).withColumn("e", normalized_energy(F.col("energy_value"), F.lit(float(n)), p))
    return rows.groupBy("method", "k").agg(F.avg("e").alias("energy"))


def _after_build(build_steps: DataFrame, swap_steps: DataFrame, k: int, amount: str) -> DataFrame:
    """The build's first k steps, then the swaps from there; ``amount`` sums up over both, and swaps by sampling keep the best."""
    keep = build_steps.filter((F.col("step") < k) & (F.substring_index("method", "_", 1) != "uniform"))
    built = keep.select(*RUN, F.lit(0).alias("phase"), F.col("step").alias("at"), "energy_value", amount)
    swaps = swap_steps.filter((F.col("k") == k) & (F.substring_index("method", "_", 1) != "uniform"))
    best = F.min("energy_value").over(_so_far(RUN, "swap_no"))
    value = F.when(F.col("method").endswith("_sampling"), best).otherwise(F.col("energy_value"))
    moved = swaps.select(*RUN, F.lit(1).alias("phase"), F.col("swap_no").alias("at"), value.alias("energy_value"), amount)
    both = built.unionByName(moved)
    order = Window.partitionBy(*RUN).orderBy("phase", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(f"total_{amount}", F.sum(amount).over(order))


def energy_by_time(build_steps: DataFrame, swap_steps: DataFrame, n: int, k: int, p: float | None) -> DataFrame:
    rows = _after_build(build_steps, swap_steps, k, "seconds")
    return rows.select(*RUN, "phase", "at", "total_seconds", normalized_energy(F.col("energy_value"), F.lit(float(n)), p).alias("energy"))


def energy_by_calls(build_steps: DataFrame, swap_steps: DataFrame, n: int, k: int, p: float | None) -> DataFrame:
    """Against projections: one for a sampled prototype, n - j for a searched one, 2 (w + 1) and k (w + 1) for swaps after w trials in vain."""
    search = F.substring_index("method", "_", 1) == "search"
    built = build_steps.withColumn("calls", F.when(search, F.lit(n) - F.col("step")).otherwise(F.lit(1)).cast("long"))
    tries = F.col("stagnation") + 1
    moved = swap_steps.withColumn("calls", F.when(F.col("method").endswith("_search"), k * tries).otherwise(2 * tries).cast("long"))
    rows = _after_build(built, moved, k, "calls")
    return rows.select(*RUN, "phase", "at", "total_calls", normalized_energy(F.col("energy_value"), F.lit(float(n)), p).alias("energy"))


def forced_trivial_swaps(swap_steps: DataFrame) -> DataFrame:
    """k, seed, forced swaps, trivial trials and rows of sampling swaps."""
    return swap_steps.groupBy("k", "seed").agg(
        F.count_if(F.col("stagnation") >= F.col("k")).alias("forced"), F.sum("stagnation").alias("trivial"), F.count(F.lit(1)).alias("total"))


def final_prototypes(protos: DataFrame) -> DataFrame:
    """Of every method: the first seed's set with the largest k."""
    best = protos.groupBy("method").agg(F.min(F.struct(F.col("seed"), -F.col("k"))).alias("b")).select("method", F.col("b.seed").alias("seed"), (-F.col("b.col2")).alias("k"))
    return protos.join(F.broadcast(best), ["method", "seed", "k"], "left_semi")


def prototype_labels(protos: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """The last seed's first k prototypes of every method with their labels, sorted by label."""
    last = protos.groupBy("method").agg(F.max("seed").alias("seed"))
    chosen = protos.filter(F.col("slot") < k).join(last, ["method", "seed"])
    return chosen.join(pts.select("id", "label"), "id").select("method", "slot", "id", "label").orderBy("method", "label", "slot")


def reconstructions(protos: DataFrame, pts: DataFrame, energy: str | Energy, ks: list[int], exemplar_method: str = "search_search", p: float | None = 2) -> DataFrame:
    """method, k, id, recon and error of one row, whose error under ``exemplar_method`` (largest k) is nearest to the mean."""
    sets = {r.method: r.ids for r in final_prototypes(protos).groupBy("method").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda s: s["id"]).alias("ids")).collect()}
    first = prototypes(pts, sets[exemplar_method][: max(ks)])
    who = exemplar_nearest_mean_error(reconstruction_error(pts, first, energy, p))
    one, out = pts.filter(F.col("id") == who), None
    for method, ids in sorted(sets.items()):
        for k in ks:
            rows = reconstruction_error(one, prototypes(pts, ids[:k]), energy, p).select(F.lit(method).alias("method"), F.lit(k).alias("k"), "id", "recon", "error")
            out = rows if out is None else out.union(rows)
    return out


def energy_range(by_k: DataFrame) -> DataFrame:
    """Least and greatest mean energy over methods at the largest k of each."""
    last = by_k.groupBy("method").agg(F.max_by("energy", "k").alias("e"))
    return last.agg(F.min("e").alias("low"), F.max("e").alias("high"))
