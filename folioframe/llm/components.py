"""Connected components by repeated contraction, in joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.storage import drop_table, write_table


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of a link: root is one node of its component. Loops, repeated links and nulls do no harm.

    Each round every node points at the least of itself and its neighbours, and links are drawn anew between what their
    ends point at; at least half of the nodes that still have links go. Then the rounds' pointers are followed. Links
    and pointers stay in tables; nothing comes to the driver. The nodes' numbers should be in no order along the links
    (hashes are not), else more rounds are needed.
    """
    spark = links.sparkSession
    ends = links.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    now, path = write_table(ends, "links")
    pointers: list[DataFrame] = []
    paths: list[str] = []
    while not now.isEmpty():
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        pointer, pointer_at = write_table(least, "pointers")
        pointers.append(pointer)
        paths.append(pointer_at)
        first = pointer.select(F.col("node").alias("a"), F.col("to").alias("x"))
        second = pointer.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = now.join(first, "a").join(second, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before = path
        now, path = write_table(moved, "links")
        drop_table(spark, before)
    if not pointers:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop_table(spark, path)
    roots = pointers.pop().withColumnRenamed("to", "root")
    while pointers:
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("r"))
        roots = pointers.pop().join(later, "to", "left").select("node", F.coalesce("r", "to").alias("root"))
    roots, _ = write_table(roots, "roots")
    drop_table(spark, *paths)
    return roots
