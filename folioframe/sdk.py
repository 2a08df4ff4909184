"""One-line use: frames of formulas or Markdown in, a format out."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import convert, documents
from folioframe.plans.graph import Context
from folioframe.plans.image_nodes import document_graph
from folioframe.sources.models import read_images

PRINTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "latex": documents.latex,
    "latex_display": documents.latex_display,
    "latex_equation": documents.latex_equation,
    "typst": documents.typst_document,
    "mathml": documents.mathml,
    "omml": documents.omml,
    "json": lambda blocks: documents.to_json(blocks).withColumnRenamed("json", "body"),
    "markdown": documents.markdown,
    "html": documents.html,
    "svg": documents.svg,
    "text": documents.render_text,
}


class Folio:
    """A frame of documents' blocks."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @classmethod
    def from_markdown(cls, df: DataFrame, key: str, text: str) -> Folio:
        rows = convert.expand(df, key, text, convert.MarkdownBlocks)
        return cls(rows.select(F.col(key).alias("doc_id"), F.lit(0).alias("page_idx"), "ord", "kind", "level", "text"))

    @classmethod
    def from_images(cls, images: DataFrame, mode: str = "mixed", **models) -> Folio:
        """Of images (image_id, width, height, format, pixels), a document each; models as plans.image_nodes names them."""
        return cls(document_graph(mode).run(Context({"images": images}, dict(models))).frames["blocks"])

    @classmethod
    def from_files(cls, spark: SparkSession, path: str, mode: str = "mixed", **models) -> Folio:
        """Of image files; a document's id is a hash of its path, and a file that is no image has no blocks."""
        images = read_images(spark, path).where("error IS NULL").withColumn("image_id", F.xxhash64("path"))
        return cls.from_images(images, mode, **models)

    def to(self, format: str) -> DataFrame:
        if format not in PRINTERS:
            raise ValueError(f"unknown format: {format}")
        return PRINTERS[format](self.blocks)

    def write(self, format: str, path: str) -> None:
        """(doc_id, body) of a format as Parquet files, in place of what is there."""
        self.to(format).write.mode("overwrite").parquet(path)

    def to_all(self, formats: tuple[str, ...] = tuple(PRINTERS)) -> DataFrame:
        """(doc_id, format, body) in one table."""
        made = [self.to(f).select("doc_id", F.lit(f).alias("format"), "body") for f in formats]
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out


class EventBus:
    """Handlers by event type, called in the order they subscribed."""

    def __init__(self):
        self.handlers: dict[str, list] = defaultdict(list)

    def subscribe(self, kind: str, handler: Callable[[dict], None]) -> None:
        self.handlers[kind].append(handler)

    def emit(self, kind: str, **event) -> None:
        for handler in self.handlers[kind]:
            handler(event)


class MemoryLog(logging.Handler):
    """Log entries kept in memory, by level."""

    def __init__(self):
        super().__init__()
        self.entries: list[logging.LogRecord] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.entries.append(record)

    def of_level(self, level: int) -> list[logging.LogRecord]:
        return [e for e in self.entries if e.levelno == level]

    def clear(self) -> None:
        self.entries.clear()
