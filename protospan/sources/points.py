"""Point tables: id LONG, features ARRAY<DOUBLE>, label (may be null)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id_col: str, vector_col: str, label_col: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored table as points. Text formats hold the vector as a JSON array of numbers."""
    df = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)
    return points(df, id_col, vector_col, label_col)


def points(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    v = F.col(vector_col)
    if dict(df.dtypes)[vector_col] == "string":
        v = F.from_json(v, "array<double>")
    cols = [F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("features")]
    return df.select(*cols, *([F.col(label_col).alias("label")] if label_col else []))


def assemble(df: DataFrame, id_col: str, cols: list[str], label_col: str | None = None) -> DataFrame:
    """Scalar columns as the coordinates of points."""
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("features"), *([F.col(label_col).alias("label")] if label_col else []))


def complex_points(df: DataFrame, id_col: str, re_col: str, im_col: str) -> DataFrame:
    """Complex points for the low-rank energy: re and im in place of features."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(re_col).cast("array<double>").alias("re"), F.col(im_col).cast("array<double>").alias("im"))
