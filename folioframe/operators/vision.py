"""Models run over frames of images, in Arrow batches: detection and recognition of formulas and text.

A frame of images is (image_id, width, height, format, pixels). `load` gives a worker's session; without model files it is
the stub, whose zeros hold nothing. An image that cannot be read has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import boxes as b
from folioframe.operators import images as im
from folioframe.operators.recognize import Session, session
from folioframe.operators.signals import SKIPPED, greedy_tokens

#: What the models take where no configuration says otherwise.
FORMULA_SIDE = 768
TEXT_SIDE, TEXT_STRIDE = 960, 32
CROP_SIDE = 384
LINE_HEIGHT, LINE_BASE = 48, 320
CONFIDENCE = 0.9
IMAGENET = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
HALVES = ([0.5] * 3, [0.5] * 3)


def _each(images: DataFrame, found: Callable[[np.ndarray], list[tuple]], schema: str, boxed: bool = False) -> DataFrame:
    """The rows that found(pixels) gives, for every image, after its image_id; boxed: and box_id, if images have one."""
    keys = ["image_id", *(["box_id"] if boxed and "box_id" in images.columns else [])]
    schema = ", ".join(["image_id long", "box_id int"][: len(keys)]) + ", " + schema
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for *key, w, h, kind, pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pixels is None or kind not in im.CHANNELS or len(pixels) != w * h * im.CHANNELS[kind]:
                    continue
                rows = [(*key, *r) for r in found(im.array(w, h, kind, pixels))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return images.select(*keys, "width", "height", "format", "pixels").mapInArrow(run, schema)


def _colors(a: np.ndarray) -> np.ndarray:
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]


def anchors(images: DataFrame, load: Callable[[], Session] = session, side: int = FORMULA_SIDE, name: str = "images") -> DataFrame:
    """(image_id, anchor, cx, cy, w, h, c0, c1): the detector's raw boxes, back on the image's own scale.

    The output may list anchors in rows or in columns; one without four numbers and a score an anchor holds none.
    """

    def found(a):
        boxed, scale, x, y = im.letterbox(_colors(a), side)
        out = next(iter(load().run({name: im.normalize(boxed, [0.0] * 3, [1.0] * 3)[None]}).values()))
        out = out[0] if out.ndim == 3 else out
        if out.ndim != 2:
            return []
        out = (out.T if out.shape[0] < out.shape[1] else out).astype(float)
        if out.shape[1] < 5:
            return []
        scores = out[:, 4:6] if out.shape[1] > 5 else np.column_stack([out[:, 4], np.zeros(len(out))])
        return [(k, (o[0] - x) / scale, (o[1] - y) / scale, o[2] / scale, o[3] / scale, *map(float, s)) for k, (o, s) in enumerate(zip(out[:, :4].tolist(), scores.tolist(), strict=True))]

    return _each(images, found, "anchor long, cx double, cy double, w double, h double, c0 double, c1 double")


def detect_formulas(images: DataFrame, load: Callable[[], Session] = session, side: int = FORMULA_SIDE, logits: bool = False) -> DataFrame:
    """Formula boxes of images: anchors, decoded and suppressed; logits: the model's scores still need the sigmoid."""
    return b.suppress(b.decode_anchors(anchors(images, load, side), logits=logits))


def text_size(width: int, height: int, most: int = TEXT_SIDE, stride: int = TEXT_STRIDE) -> tuple[int, int]:
    """The sides that a text detector takes: scaled down to most, multiples of the stride, and a stride at least."""
    scale = min(1.0, most / max(width, height))
    return tuple(max(stride, int(round(x * scale / stride)) * stride) for x in (width, height))


def detect_text(images: DataFrame, load: Callable[[], Session] = session, on: float = 0.3, least: float = 0.5, grown: float = 1.6, name: str = "x") -> DataFrame:
    """(image_id, box_id, x, y, w, h, confidence): text regions of the probability map, grown, back on the image and cut to it."""

    def found(a):
        w, h = text_size(a.shape[1], a.shape[0])
        out = next(iter(load().run({name: im.normalize(im.resize(_colors(a), w, h), *IMAGENET)[None]}).values()))
        p, rows = np.asarray(out, float).reshape(-1, *out.shape[-2:])[0], []
        sx, sy = p.shape[1] / a.shape[1], p.shape[0] / a.shape[0]
        for x, y, bw, bh, _ in im.components(np.where(p > on, 1.0, 0.0)):
            score = float(p[y : y + bh, x : x + bw].mean())
            if score < least:
                continue
            far = bw * bh * grown / (2 * (bw + bh))
            x0, y0, x1, y1 = (x - far) / sx, (y - far) / sy, (x + bw + far) / sx, (y + bh + far) / sy
            x0, y0, x1, y1 = max(0.0, x0), max(0.0, y0), min(float(a.shape[1]), x1), min(float(a.shape[0]), y1)
            if x1 - x0 >= 1 and y1 - y0 >= 1:
                rows.append((len(rows) + 1, x0, y0, x1 - x0, y1 - y0, score))
        return rows

    return _each(images, found, "box_id int, x double, y double, w double, h double, confidence double")


def padded(boxes: DataFrame, share: float = 0.2, least: float = 4.0) -> DataFrame:
    """Boxes grown upwards and downwards by a share of their height, and not above the image."""
    pad = F.greatest(F.floor(F.col("h") * share).cast("double"), F.lit(least))
    top = F.greatest(F.col("y") - pad, F.lit(0.0))
    return boxes.withColumns({"y": top, "h": top + F.col("h") + 2 * pad - top})


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """A frame of images with the part of each box, and its box_id; boxes of an image are cut in one task. An image of the wrong size has none."""
    listed = boxes.groupBy("image_id").agg(F.collect_list(F.struct("box_id", "x", "y", "w", "h")).alias("parts"))
    schema = "image_id long, box_id int, width int, height int, format string, pixels binary"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i, w, h, kind, pixels, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pixels is None or kind not in im.CHANNELS or len(pixels) != w * h * im.CHANNELS[kind]:
                    continue
                whole, rows = im.array(w, h, kind, pixels), []
                for p in parts:
                    a = np.ascontiguousarray(im.crop(whole, p["x"], p["y"], p["w"], p["h"]))
                    rows.append((i, p["box_id"], a.shape[1], a.shape[0], kind, a.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in schema.split(", ")])

    return images.join(listed, "image_id").select("image_id", "width", "height", "format", "pixels", "parts").mapInArrow(run, schema)


def recognize_text(lines: DataFrame, keys: dict[int, str], load: Callable[[], Session] = session, blank: int = 0, height: int = LINE_HEIGHT, base: int = LINE_BASE, name: str = "x") -> DataFrame:
    """(image_id, text, confidence) of images of single lines: padded on the right, greedy CTC; the confidence is the mean of the letters' scores."""

    def found(a):
        wide = max(1, int(np.ceil(height * a.shape[1] / a.shape[0])))
        x = np.zeros((3, height, max(base, wide)), np.float32)
        x[:, :, :wide] = im.normalize(im.resize(_colors(a), wide, height), *HALVES)
        out = next(iter(load().run({name: x[None]}).values()))
        if out.ndim != 3:
            return [("", 0.0)]
        best, top = out[0].argmax(axis=1), out[0].max(axis=1)
        letters = [k for k in range(len(best)) if best[k] != blank and (k == 0 or best[k] != best[k - 1])]
        text = "".join(keys.get(int(best[k]), "") for k in letters)
        return [(text, float(np.mean(top[letters])) if text else 0.0)]

    return _each(lines, found, "text string, confidence double", boxed=True)


def recognize_formulas(formulas: DataFrame, vocabulary: dict[int, str], encoder: Callable[[], Session] = session, decoder: Callable[[], Session] = session, start: int = 0, most: int = 256, side: int = CROP_SIDE, by_line: bool = False) -> DataFrame:
    """(image_id, latex, confidence) of images of single formulas: encoded once, decoded token by token; the confidence is a constant.

    by_line: a formula of several lines is read line by line, with spaces between.
    """

    def found(a):
        parts = (im.line_groups(a) or [a]) if by_line else [a]
        return [(" ".join(filter(None, map(read, parts))), CONFIDENCE)]

    def read(a):
        encoded = next(iter(encoder().run({"pixel_values": im.normalize(im.resize(_colors(a), side, side), *HALVES)[None]}).values()))

        def step(ids):
            out = next(iter(decoder().run({"input_ids": np.array([ids], np.int64), "encoder_hidden_states": encoded}).values()))
            return out[0, -1].tolist() if out.ndim == 3 else [1.0, 0.0, 0.0]

        words = [vocabulary.get(t, "") for t in greedy_tokens(step, start, most)]
        return "".join(w.replace("Ġ", " ").replace("Ā", " ") for w in words if w not in SKIPPED).strip()

    return _each(formulas, found, "latex string, confidence double", boxed=True)
