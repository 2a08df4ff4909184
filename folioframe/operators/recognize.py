"""Recognition without model files: a stub runtime, a mock pipeline, merging of regions, and stream items."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import boxes as b


class Session(Protocol):
    """A loaded model in a worker process."""

    def run(self, tensors: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...


class StubSession:
    """Zeros of each input's shape, under its name and _output."""

    def run(self, tensors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {f"{name}_output": np.zeros_like(x) for name, x in tensors.items()}


_SESSIONS: dict[str, Session] = {}


def session(path: str | None = None) -> Session:
    """One session a worker and model path; without a path, the stub."""
    key = path or ""
    if key not in _SESSIONS:
        if path:
            import onnxruntime

            loaded = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])

            class _Onnx:
                def run(self, tensors):
                    return dict(zip([o.name for o in loaded.get_outputs()], loaded.run(None, tensors), strict=True))

            _SESSIONS[key] = _Onnx()
        else:
            _SESSIONS[key] = StubSession()
    return _SESSIONS[key]


def argmax_orientation(scores: str):
    """0, 90, 180 or 270 degrees: the place of the largest of four scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int") * 90


def mock_recognition(boxes: DataFrame, formulas: DataFrame) -> DataFrame:
    """boxes with latex and display: an image's detections, by box_id, zipped with results, which begin at its number and wrap around."""
    n = formulas.agg(F.max("formula_id").alias("n")).withColumn("one", F.lit(1))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id"))
    matched = boxes.withColumn("one", F.lit(1)).withColumn("nth", place).join(F.broadcast(n), "one").withColumn("formula_id", F.pmod(F.col("image_id") + F.col("nth"), "n") + 1)
    return matched.join(formulas, "formula_id").select(*[matched[c] for c in boxes.columns], "latex", (F.col("class_name") == "isolated").alias("display"))


def merge_regions(formulas: DataFrame, texts: DataFrame) -> DataFrame:
    """Formula and text regions of each image in one order: by y, formulas before texts at the same height, then by id."""
    columns = ["image_id", "box_id", "y"]
    both = formulas.select(*columns, F.lit(0).alias("rank")).unionByName(texts.select(*columns, F.lit(1).alias("rank")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "rank", "box_id")))


def limited(regions: DataFrame, max_regions: int = 100, min_confidence: float = 0.25) -> DataFrame:
    """What a request asks for: confident regions, and no more than so many an image."""
    return b.most_confident(regions.where(F.col("confidence") >= min_confidence), max_regions).drop("place")


def stream_items(regions: DataFrame) -> DataFrame:
    """(image_id, seq, item, box_id, confidence): a row as each region is recognised, and one when the image is done."""
    order = Window.partitionBy("image_id").orderBy("y", "x", "box_id")
    each = regions.select("image_id", F.row_number().over(order).alias("seq"), F.lit("region_recognized").alias("item"), "box_id", "confidence")
    done = regions.groupBy("image_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("seq")).select("image_id", "seq", F.lit("completed").alias("item"), F.lit(None).cast("int").alias("box_id"), F.lit(None).cast("double").alias("confidence"))
    return each.unionByName(done)
