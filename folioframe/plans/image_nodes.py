"""Nodes that run models over the frame `images` of a context, and the graph from images to blocks.

Sessions come from the context's metadata under a node's model name (a function that gives a worker's session); without
one the stub runs, which finds nothing. A node whose input frame is missing makes none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import boxes as b
from folioframe.operators import images as im
from folioframe.operators import vision as v
from folioframe.operators.recognize import session
from folioframe.plans.graph import Context, Graph, Node

KINDS = ("formula", "text")
LEAST_SIDE = 4


def _loader(context: Context, model: str):
    return context.metadata.get(model, session)


@dataclass
class ResizeNode(Node):
    """The images at one size."""

    width: int
    height: int
    name: str = "resize"

    def process(self, context: Context) -> DataFrame | None:
        images = context.frames.get("images")
        return None if images is None else im.map_images(images, lambda a: im.resize(a, self.width, self.height))


@dataclass
class NormalizeNode(Node):
    """The images' values with mean and deviation taken out, and both noted in the metadata."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    name: str = "normalize"

    def process(self, context: Context) -> DataFrame | None:
        context.metadata |= {"normalize_mean": list(self.mean), "normalize_std": list(self.std)}
        images = context.frames.get("images")
        return None if images is None else im.normalized(images, list(self.mean), list(self.std))


@dataclass
class DetectorNode(Node):
    """Boxes of a kind on the images."""

    kind: str

    def __post_init__(self):
        self.name = f"detect_{self.kind}"

    def process(self, context: Context) -> DataFrame | None:
        images = context.frames.get("images")
        if images is None:
            return None
        load = _loader(context, f"{self.kind}_detector")
        if self.kind == "formula":
            return b.large_and_sure(b.group_nearby(v.detect_formulas(images, load, context.metadata.get("side", v.FORMULA_SIDE))))
        return v.detect_text(images, load)


@dataclass
class CropNode(Node):
    """The part of its image that each box holds; text boxes with a margin above and below, none under four pixels."""

    kind: str

    def __post_init__(self):
        self.name = f"crop_{self.kind}"

    def process(self, context: Context) -> DataFrame | None:
        boxes = context.frames.get(f"detect_{self.kind}")
        if boxes is None:
            return None
        large = boxes.where((F.col("w") >= LEAST_SIDE) & (F.col("h") >= LEAST_SIDE))
        return v.crops(context.frames["images"], v.padded(large) if self.kind == "text" else large)


@dataclass
class RecognizerNode(Node):
    """(image_id, box_id, text, confidence) of the crops; formulas line by line. `vocabulary` and `keys` come from the metadata."""

    kind: str

    def __post_init__(self):
        self.name = f"recognize_{self.kind}"

    def process(self, context: Context) -> DataFrame | None:
        cut, said = context.frames.get(f"crop_{self.kind}"), context.metadata
        if cut is None:
            return None
        if self.kind == "text":
            return v.recognize_text(cut, said.get("keys", {}), _loader(context, "text_recognizer"))
        read = v.recognize_formulas(cut, said.get("vocabulary", {}), _loader(context, "formula_encoder"), _loader(context, "formula_decoder"), by_line=True)
        return read.withColumnRenamed("latex", "text")


@dataclass
class PostprocessNode(Node):
    """The regions read as blocks, from top to bottom: formulas, and paragraphs that are not empty, with their places."""

    kinds: tuple[str, ...] = KINDS
    name: str = "blocks"

    def process(self, context: Context) -> DataFrame | None:
        found = None
        for kind in self.kinds:
            read, boxes = context.frames.get(f"recognize_{kind}"), context.frames.get(f"detect_{kind}")
            if read is None:
                continue
            rect = boxes.select("image_id", "box_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
            one = read.join(rect, ["image_id", "box_id"]).withColumn("kind", F.lit("formula" if kind == "formula" else "paragraph"))
            one = one if kind == "formula" else one.where("text <> ''")
            found = one if found is None else found.unionByName(one)
        if found is None:
            return None
        order = Window.partitionBy("image_id").orderBy("y", "kind", "x", "box_id")
        rank = F.row_number().over(order)
        return found.select(F.col("image_id").alias("doc_id"), F.lit(0).alias("page_idx"), rank.alias("ord"), "kind", F.lit(0).alias("level"), "text", *"xywh", "confidence")


def document_graph(mode: str = "mixed") -> Graph:
    """Detect, crop, recognise and join, for formulas, text or both; the frame `blocks` is its result."""
    kinds = {"formula": ("formula",), "text": ("text",), "mixed": KINDS}.get(mode)
    if kinds is None:
        raise ValueError(f"unknown mode: {mode}")
    graph = Graph()
    for kind in kinds:
        graph.add(DetectorNode(kind)).add(CropNode(kind), [f"detect_{kind}"]).add(RecognizerNode(kind), [f"crop_{kind}"])
    return graph.add(PostprocessNode(kinds), [f"recognize_{kind}" for kind in kinds])
