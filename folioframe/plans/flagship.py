"""The flagship query: detection boxes to Markdown pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.fixtures import view
from folioframe.operators import boxes as b
from folioframe.operators import documents as d
from folioframe.operators import recognize as r


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): of each image the boxes that survive suppression and filters, in reading order, as a Markdown page."""
    kept = b.reading_order(b.large_and_sure(b.suppress(view(spark, sf_dir, "v_boxes"))))
    placed = r.mock_recognition(kept, view(spark, sf_dir, "v_formulas"))
    kind = F.when(F.col("display"), "formula").otherwise("paragraph")
    text = F.when(F.col("display"), F.col("latex")).otherwise(F.concat(F.lit("$"), F.col("latex"), F.lit("$")))
    blocks = placed.select(F.col("image_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("place").alias("ord"), kind.alias("kind"), F.lit(1).alias("level"), text.alias("text"))
    return d.markdown(blocks)
