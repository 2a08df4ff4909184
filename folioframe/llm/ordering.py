"""Document order: doc_id ascending, nulls last, then the text's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.storage import free_name, write_table

#: Name of the added column where no column is called so.
NUMBER = "folioframe_number"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a unique long in document order, the id itself where ids are unique."""
    name = free_name(docs.columns, NUMBER)
    twice = docs.select(F.col(id_col).cast("long").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null")
    if twice.isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long")), name
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)).withColumn(name, F.monotonically_increasing_id())
    return write_table(ordered, "numbered")[0], name
