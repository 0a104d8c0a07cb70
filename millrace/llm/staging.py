"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset and the master is local, a temporary folder; a cluster's
    executors wouldn't share one, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"


_TABLES: list[str] = []  # folders of staged tables that haven't been removed


_FEW, _TASK_BYTES = 16, 2 << 20


def few_tasks(*tables: DataFrame) -> int:
    """Tasks for a table made of these staged ones: 16, and one more for each 2 MB that they take. Else every partition of a
    shuffle writes a file, however few rows it has."""
    total = 0
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        total += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return _FEW + total // _TASK_BYTES


def staged(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """df, written once as Parquet, by so many tasks at most, and read back: a lost executor costs a re-read, not a recomputation.

    The finished query's shuffle files are of no more use; the driver's garbage collection lets Spark delete them.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    _TABLES.append(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    remove(df.sparkSession, df.staged_at)
    if df.staged_at in _TABLES:
        _TABLES.remove(df.staged_at)


def staged_so_far() -> int:
    return len(_TABLES)


def release(spark: SparkSession, since: int) -> None:
    """Removes the tables staged since then; for when what was made of them is written."""
    for path in _TABLES[since:]:
        remove(spark, path)
    del _TABLES[since:]


def settled(df: DataFrame, label: str, since: int, tasks: int | None = None) -> DataFrame:
    """df, staged, without the tables staged since then, which it was made of."""
    out = staged(df, label, tasks)
    for path in _TABLES[since:-1]:
        remove(df.sparkSession, path)
    del _TABLES[since:-1]
    return out
