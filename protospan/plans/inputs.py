"""Point tables and step tables made from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protospan.operators.experiment import METHODS
from protospan.sources.points import points


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return points(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


EMB = "emb AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitems(spark: SparkSession, d: str) -> DataFrame:
    """Line items as points of four scaled coordinates; the id is a hash of the columns that tell rows apart.

    Dealt to all cores, as the file is one row group, which a single task would read.
    """
    df = table(spark, d, "lineitem").select(*LINE_KEY, "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    df = df.repartition(spark.sparkContext.defaultParallelism)
    cents = [F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in LINE_KEY], *cents)
    ident = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    v = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return df.select(ident.alias("id"), v.alias("features"), F.col("l_returnflag").alias("label"))


LINE = """line AS MATERIALIZED (
    SELECT ('0x' || substr(md5(concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
               round(l_extendedprice * 100)::BIGINT::VARCHAR, round(l_quantity * 100)::BIGINT::VARCHAR,
               round(l_discount * 100)::BIGINT::VARCHAR, round(l_tax * 100)::BIGINT::VARCHAR)), 1, 15))::BIGINT AS id,
           [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] AS e, l_returnflag AS label
    FROM lineitem)"""


SWAPPED = [m for m in METHODS if "_" in m]


def _one_of(names: list[str]):
    return F.element_at(F.array(*[F.lit(m) for m in names]), (F.col("user_id") % len(names) + 1).cast("int"))


def _seed(names: list[str]):
    return (42 + F.floor(F.col("user_id") / len(names))).cast("int").alias("seed")


def build_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as the steps of builds, a run for each user."""
    df = table(spark, d, "events").select(_one_of(METHODS).alias("method"), _seed(METHODS), "event_id", "value")
    step = F.row_number().over(Window.partitionBy("method", "seed").orderBy("event_id")) - 1
    return df.select("method", "seed", step.alias("step"), F.col("event_id").alias("id"), ((F.col("event_id") % 7 + 1) / 100).alias("seconds"), (F.col("value") + 1).alias("energy_value"))


def swap_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as the steps of swaps, a run for each user, from five or six prototypes."""
    df = table(spark, d, "events").select(_one_of(SWAPPED).alias("method"), _seed(SWAPPED), (5 + F.col("event_id") % 2).cast("int").alias("k"), "event_id", "value")
    no = F.row_number().over(Window.partitionBy("method", "seed", "k").orderBy("event_id"))
    return df.select("method", "seed", "k", no.alias("swap_no"), ((F.col("event_id") % 7 + 1) / 100).alias("seconds"), (F.col("value") + 1).alias("energy_value"), (F.col("event_id") % 13).alias("stagnation"))


STEPS = f"""built AS (
    SELECT {METHODS}[user_id % 5 + 1] AS method, (42 + user_id // 5)::INTEGER AS seed, event_id AS id,
           (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS step,
           (event_id % 7 + 1) / 100 AS seconds, value + 1 AS energy_value
    FROM events),
swapped AS (
    SELECT {SWAPPED}[user_id % 2 + 1] AS method, (42 + user_id // 2)::INTEGER AS seed, (5 + event_id % 2)::INTEGER AS k,
           row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id)::INTEGER AS swap_no,
           (event_id % 7 + 1) / 100 AS seconds, value + 1 AS energy_value, event_id % 13 AS stagnation
    FROM events)"""
