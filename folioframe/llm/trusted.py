"""The trusted rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trusted_ids(labels: DataFrame, most: int | None) -> DataFrame:
    """(doc_id, h): ids that are labelled quality 1 and toxic 0; at most so many, the least by a hash, if `most` is given.

    Repeated labels count with their worst values; null labels and null ids trust nothing.
    """
    worst = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("unknown"))
    good = worst.where("q = 1 and t = 0 and unknown = 0 and doc_id is not null").select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    if most is None:
        return good
    n = good.count()
    if n > most:
        cut = -(1 << 63) + int((1 << 64) * min(1.0, 1.2 * most / n)) - 1  # so that each partition sorts its share, not `most` rows
        good = good.where(F.col("h") <= cut)
    return good.orderBy("h", "doc_id").limit(most)
