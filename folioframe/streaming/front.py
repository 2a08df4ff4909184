"""A Structured Streaming front end (an extension): files of rows in, the batch operators on every micro-batch.

The operators used here work row by row or image by image inside a batch, so no state and no watermark is kept. A batch
that is run again overwrites its own folder, so each is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def rows_of_files(spark: SparkSession, path: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Start writing operator(batch) of every micro-batch as Parquet below `out`, until the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
