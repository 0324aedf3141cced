"""Results of runs as Parquet tables, a partition a run; rewriting a run replaces its partition alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN = ["dataset", "energy", "p", "method", "seed"]


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("p", _text("p"))


def _text(name: str):
    from pyspark.sql import functions as F

    # A partition's value may come back as a number.
    return F.regexp_replace(F.col(name).cast("string"), r"\.0$", "")
