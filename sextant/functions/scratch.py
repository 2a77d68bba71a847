"""Intermediate tables that are written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no folder, as in tests and benchmarks on one machine.
LOCAL = "/tmp/checkpoints"
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL


def scratch_folder(spark: SparkSession) -> str:
    """The name of a fresh folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/sextant-{uuid.uuid4().hex}"
    folder, files = file_system(spark, path)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there.

    The folder goes when the application ends, if ``discard`` hasn't removed it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sextant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, files = file_system(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._sextant_path = path
    if _open:
        _open[-1].append(out)
    return out


#: Rows of a task, of those that a row becomes. Tables of short values take few bytes, so tasks by bytes would get ever more rows.
TASK_ROWS = 250_000


def tasks_for(table: DataFrame, times: int) -> int:
    """Tasks for what becomes of ``table``, each row of which becomes ``times`` rows."""
    return max(1, ceil(table.count() * times / TASK_ROWS))


def spread(table: DataFrame, key: str, times: int) -> DataFrame:
    """``table``, of which every row becomes ``times`` rows, dealt by ``key`` to as many tasks as its rows need."""
    return table.repartition(tasks_for(table, times), key)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that ``durable`` writes meanwhile are removed at the end, but for those put into the list."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        for table in _open.pop():
            if not any(table is k for k in kept):
                discard(table)


def discard(df: DataFrame) -> None:
    """Remove a table of ``durable`` that nothing will read again."""
    folder, files = file_system(df.sparkSession, df._sextant_path)
    files.delete(folder, True)
    files.cancelDeleteOnExit(folder)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())
