"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is given, a temporary one, but only if all runs in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"


#: The setting by which a query's shuffle files go with it. A DataFrame that is run again makes them anew.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that spill has written within each open cleared().
_open: list[list[str]] = []


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    path, system = _path(spark, name)
    system.delete(path, True)


def delete_at_exit(spark: SparkSession, name: str) -> None:
    """The folder goes when the driver ends."""
    path, system = _path(spark, name)
    system.deleteOnExit(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query within it deletes its shuffle files once it has ended, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what spill has written within it; for steps whose result is written elsewhere by then."""
    _open.append([])
    try:
        with shuffles_freed(spark):
            yield
    finally:
        for name in _open.pop():
            delete(spark, name)


def spill(df: DataFrame, outer: bool = False) -> DataFrame:
    """Writes df once and reads it back: cuts its lineage, and lost executors don't cost a second run of it.

    The table is deleted when the driver ends, or by the innermost cleared(), or, with outer, by the one around that.
    """
    path = fresh(df.sparkSession, "table")
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(df.sparkSession, path)
    if len(_open) > outer:
        _open[-1 - outer].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
