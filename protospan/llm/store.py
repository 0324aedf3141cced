"""Tables kept between steps, in the folder that driver and executors share, and settings for Python tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from protospan.functions.ship import ship

_written: set[str] = set()

#: Rows that a task writes, where a table's size is known, and tasks at least.
ROWS_A_TASK, LEAST_TASKS = 20_000, 12


def by_tasks(df: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than they call for: a task costs more than a few rows do."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // a_task)))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a folder of this machine if Spark runs on it alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def delete(path: str) -> None:
    """Remove a folder that Spark has written, wherever it lies, as far as Spark still runs."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def remove_later(path: str) -> str:
    """A folder that goes when the driver's Python ends."""
    if not _written:
        atexit.register(release)
    _written.add(path)
    return path


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (of about so many ``rows``, if known) written once as a table in the shared folder and read again.

    Later reads do not repeat its work, take only the columns they need, get partitions by size however
    many tasks wrote it, and cost nothing when executors are lost. The table goes with ``release``, or
    when the driver's Python ends.
    """
    path = remove_later(f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    (df if rows is None else by_tasks(df, rows)).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later step reads; without arguments, all there are.

    The driver's garbage goes with them: only when it is collected do executors drop the shuffle files of past steps.
    """
    for path in [t._written_to for t in tables] or list(_written):
        try:
            delete(path)
        except Exception:  # noqa: BLE001, S110  the session may be gone, and with it what it kept
            pass
        _written.discard(path)
    sc = SparkContext._active_spark_context
    if tables and sc is not None:
        sc._jvm.System.gc()


def python_ready(spark: SparkSession) -> None:
    """Sources sent to the workers, and Arrow batches of few rows, as a row may hold a whole long text."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 25)):
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))
