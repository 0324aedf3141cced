"""Synthetic point tables, made by Spark from row numbers: alike on any partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions.vectors import gauss, norm, uniform


def _normals(seed: int, d: int, ident="id"):
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: gauss(seed, j, ident))


def make_gaussian(spark: SparkSession, n: int = 500, d: int = 50, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", _normals(seed, d).alias("features"))


def make_blobs(spark: SparkSession, counts: list[int], d: int, std: float, seed: int = 42) -> DataFrame:
    """Gaussian groups of the given sizes around centres uniform in [0, 1]; label is the group."""
    ends = [sum(counts[: k + 1]) for k in range(len(counts))]
    label = F.lit(len(counts) - 1)
    for k in reversed(range(len(counts) - 1)):
        label = F.when(F.col("id") < ends[k], k).otherwise(label)
    rows = spark.range(sum(counts)).withColumn("label", label.cast("int"))
    centre = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: uniform(seed, F.concat(F.lit("c"), j.cast("string")), "label"))
    return rows.select("id", F.zip_with(centre, _normals(seed, d), lambda c, z: c + F.lit(float(std)) * z).alias("features"), "label")


def make_mixture(spark: SparkSession, n: int = 500, d: int = 100, k_true: int = 5, noise: float = 0.04, floor: float = 0.3, seed: int = 42) -> DataFrame:
    """Non-negative points: mixtures of ``k_true`` parts, of norm max(u, floor), plus noise, cut at 0."""
    parts = np.abs(np.random.default_rng(seed).normal(size=(k_true, d)))
    parts /= np.sqrt((parts**2).sum(axis=1, keepdims=True))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in parts])
    h = F.transform(F.sequence(F.lit(0), F.lit(k_true - 1)), lambda j: uniform(seed, F.concat(F.lit("h"), j.cast("string")), "id"))
    rows = spark.range(n).withColumn("h", h).withColumn("size", F.greatest(uniform(seed, "size", "id"), F.lit(floor)) / norm("h"))
    rows = rows.withColumn("parts", table).withColumn("z", _normals(seed, d))
    x = F.transform("z", lambda z, i: F.greatest(F.lit(0.0), F.lit(float(noise)) * z + F.col("size") * F.aggregate(
        F.zip_with("h", "parts", lambda a, p: a * F.element_at(p, i + 1)), F.lit(0.0), lambda s, v: s + v)))
    return rows.select("id", x.alias("features"))


def make_smile(spark: SparkSession, n: int = 10_000, eye_points: int | None = None, mouth_points: int | None = None, seed: int = 42) -> DataFrame:
    """A face: two unit discs at (-4, 4) and (4, 4), a mouth y = x^2/16 - 5 on [-5, 5], and a circle of radius 10."""
    eye = math.ceil(math.sqrt(n)) if eye_points is None else eye_points
    mouth = math.ceil(n / 10) if mouth_points is None else mouth_points
    u, v = uniform(seed, "u", "id"), 2 * math.pi * uniform(seed, "v", "id")
    r = F.sqrt(u)
    side = F.when(F.col("id") < eye, -4.0).otherwise(4.0)
    x = 10 * u - 5
    rows = spark.range(n)
    xs = F.when(F.col("id") < 2 * eye, side + r * F.cos(v)).when(F.col("id") < 2 * eye + mouth, x).otherwise(10 * F.cos(v))
    ys = F.when(F.col("id") < 2 * eye, 4 + r * F.sin(v)).when(F.col("id") < 2 * eye + mouth, x * x / 16 - 5).otherwise(10 * F.sin(v))
    return rows.select("id", F.array(xs, ys).alias("features"))


def make_robspiral(spark: SparkSession, n: int) -> DataFrame:
    """A spiral exp(t / 5) (cos t, sin t), at t = s^6 for s from 2 down to 0."""
    t = F.pow(2.0 * (n - 1 - F.col("id")) / max(1, n - 1), 6)
    grow = F.exp(0.2 * t)
    return spark.range(n).select("id", F.array(grow * F.cos(t), grow * F.sin(t)).alias("features"))


def make_outliers(spark: SparkSession, n: int = 10_000, num_outliers: int = 50, d: int = 20, seed: int = 42) -> DataFrame:
    """Small Gaussian points; ``num_outliers`` of them, at random, have a hundred standard normals added."""
    rows = spark.range(n)
    far = rows.orderBy(uniform(seed, "out", "id"), "id").limit(num_outliers).withColumn("far", F.lit(100.0))
    rows = rows.join(F.broadcast(far), "id", "left")
    small = math.sqrt(0.25 / 20)
    x = F.zip_with(_normals(seed, d), _normals(seed + 1, d), lambda a, b: small * a + F.coalesce("far", F.lit(0.0)) * b)
    return rows.select("id", x.alias("features"))
