"""Tables kept between the steps of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is not set, a folder of this machine serves if Spark runs on it alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` by checkpoint() into the shared folder: its lineage is cut, and its files outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """As ``kept``, for a table that ``dropped`` takes away when a loop has no more use for it."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete a ``written`` table. The driver's garbage goes with it: only then do executors drop the shuffle files of past steps."""
    sc = table.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(table._written_to)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    sc._jvm.System.gc()
