"""Session construction shared by the bench, the tests and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "folioframe") -> SparkSession:
    """A local session with the settings every entry point relies on; on a cluster use the given one."""
    n = str(cores or os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOFRAME_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
