"""Where jobs keep what outlives a task: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder; driver and executors share it.

    Where neither is set, a session whose tasks run in this very process (tests on one machine) makes a folder of its own;
    any other session fails, as no folder of the driver's machine is known to be shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioframe-shared-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/folioframe-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_here(spark: SparkSession):
    """Within, the shuffle files of a finished query are deleted at its end; the setting is put back after."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within, queries hand their Python workers so many rows at once; the setting is put back after."""
    before = spark.conf.get(_ROWS_AT_ONCE)
    spark.conf.set(_ROWS_AT_ONCE, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_AT_ONCE, before)


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_end_here(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete tables of write_table that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], base: str) -> str:
    """base, with underscores after it until no column is called so (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
