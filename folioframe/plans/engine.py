"""The engine's pipelines as graphs with real edges: detect, filter, recognise, merge, print."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.fixtures import view
from folioframe.operators import boxes as b
from folioframe.operators import recognize as r
from folioframe.plans.graph import Context, Graph, TransformNode

class Service(ABC):
    """Something with a life of its own beside queries; used as a context manager it is stopped in any case."""

    name: str
    running = False

    @abstractmethod
    def start(self) -> None: ...

    def stop(self) -> None:
        self.running = False

    def __enter__(self):
        self.start()
        self.running = True
        return self

    def __exit__(self, *_) -> None:
        self.stop()
        self.running = False


MODES = ("formula", "text", "mixed")


def build(mode: str = "mixed", overlap: float = b.NMS_OVERLAP, min_area: float = b.MIN_AREA, min_confidence: float = b.MIN_CONFIDENCE) -> Graph:
    """A graph over the frames `boxes` (detections with class_name) and `formulas` (formula_id, latex); the frame `merged` is its result."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    graph = Graph()
    kinds = {"formula": ("formula",), "text": ("text",), "mixed": ("formula", "text")}[mode]
    of = {"formula": "isolated", "text": "embedding"}

    def detect(kind: str):
        return lambda c: b.suppress(c.frames["boxes"].where(F.col("class_name") == of[kind]), overlap)

    def keep(kind: str):
        return lambda c: b.large_and_sure(c.frames[f"detect_{kind}"], min_area, min_confidence)

    for kind in kinds:
        graph.add(TransformNode(f"detect_{kind}", detect(kind)))
        graph.add(TransformNode(f"crop_{kind}", keep(kind)), [f"detect_{kind}"])
        graph.add(TransformNode(f"recognize_{kind}", lambda c, k=kind: r.mock_recognition(c.frames[f"crop_{k}"], c.frames["formulas"])), [f"crop_{kind}"])

    def merge(c: Context) -> DataFrame:
        frames = [c.frames[f"recognize_{k}"] for k in kinds]
        empty = frames[0].limit(0)
        return r.merge_regions(frames[0] if "formula" in kinds else empty, frames[-1] if "text" in kinds else empty)

    return graph.add(TransformNode("merged", merge), [f"recognize_{k}" for k in kinds])


def run(spark: SparkSession, sf_dir: str, mode: str = "mixed") -> DataFrame:
    context = Context(frames={"boxes": view(spark, sf_dir, "v_boxes"), "formulas": view(spark, sf_dir, "v_formulas")})
    return build(mode).run(context).frames["merged"]
