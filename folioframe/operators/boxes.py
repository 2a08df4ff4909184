"""Detection boxes as tables (image_id, box_id, x, y, w, h, confidence, class_id): decoding, suppression, grouping, splitting.

Work is per image, so a table is shuffled once, by image; null coordinates make a box drop out of comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as g

NMS_OVERLAP = 0.5
MOST_BOXES = 50
MIN_AREA = 100.0
MIN_CONFIDENCE = 0.2


def pairs(boxes: DataFrame) -> DataFrame:
    """Each pair of boxes of an image once, as structs a and b: an equi-join on the image."""
    left = boxes.select("image_id", F.struct("box_id", "x", "y", "w", "h").alias("a"))
    other = boxes.select("image_id", F.struct("box_id", "x", "y", "w", "h").alias("b"))
    return left.join(other, "image_id").where("a.box_id < b.box_id")


def decode_anchors(anchors: DataFrame, threshold: float = 0.25, scale: float = 1.0, pad_x: float = 0.0, pad_y: float = 0.0, logits: bool = True) -> DataFrame:
    """Boxes of model anchors (cx, cy, w, h, c0, c1): the larger class score at the threshold or over; class 1 only if strictly larger."""
    score = (lambda c: g.sigmoid(F.col(c))) if logits else F.col
    scored = anchors.withColumn("s0", score("c0")).withColumn("s1", score("c1")).withColumn("confidence", F.greatest("s0", "s1"))
    kept = scored.where(F.col("confidence") >= threshold)
    place = lambda c, size, pad: F.greatest(F.lit(0.0), (F.col(c) - F.col(size) / 2 - pad) / scale)
    one = F.col("s1") > F.col("s0")
    return kept.select(
        "image_id",
        F.col("anchor").alias("box_id"),
        place("cx", "w", pad_x).alias("x"),
        place("cy", "h", pad_y).alias("y"),
        (F.col("w") / scale).alias("w"),
        (F.col("h") / scale).alias("h"),
        "confidence",
        F.when(one, 1).otherwise(0).alias("class_id"),
        F.when(one, "isolated").otherwise("embedding").alias("class_name"),
    )


def suppress(boxes: DataFrame, overlap: float = NMS_OVERLAP) -> DataFrame:
    """Greedy non-maximum suppression over all classes of an image: by falling confidence, a box goes if it overlaps a kept one by more."""
    ranked = boxes.where("confidence IS NOT NULL AND NOT isnan(confidence)")
    each = F.struct((-F.col("confidence")).alias("order"), "box_id", "x", "y", "w", "h", "class_id", "class_name")
    listed = ranked.groupBy("image_id").agg(F.array_sort(F.collect_list(each)).alias("all"))
    clash = lambda kept, b: F.exists(kept, lambda k: g.intersection(k, b) > overlap * g.union(k, b))
    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda acc, b: F.when(clash(acc, b), acc).otherwise(F.concat(acc, F.array(b))))
    one = listed.select("image_id", F.explode(kept).alias("b"))
    return one.select("image_id", "b.box_id", "b.x", "b.y", "b.w", "b.h", (-F.col("b.order")).alias("confidence"), "b.class_id", "b.class_name")


def most_confident(boxes: DataFrame, most: int = MOST_BOXES) -> DataFrame:
    """The boxes of each image with the highest confidence."""
    order = Window.partitionBy("image_id").orderBy(F.col("confidence").desc(), "box_id")
    return boxes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def large_and_sure(boxes: DataFrame, min_area: float = MIN_AREA, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return boxes.where((F.col("w") * F.col("h") >= min_area) & (F.col("confidence") >= min_confidence))


def reading_order(boxes: DataFrame, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Adds `place`, from 1, down and then across; ties by box_id."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(*by, "box_id")))


def _grown(rows: list[list[float]], line: float, gap: float) -> list[tuple]:
    """(place of the first box, x, y, w, h, confidence, members) of each group of one image's boxes (x, y, w, h, confidence), in order."""
    used, out = [False] * len(rows), []
    for i, (x, y, w, h, best) in enumerate(rows):
        if used[i]:
            continue
        r, b, members = x + w, y + h, 1
        for j in range(i + 1, len(rows)):
            if used[j]:
                continue
            ox, oy, ow, oh, confidence = rows[j]
            height, width = (b - y + oh) / 2, (r - x + ow) / 2
            if abs((y + b) / 2 - (oy + oh / 2)) <= line * height and max(ox - r, x - ox - ow, 0.0) < gap * width:
                used[j] = True
                x, y, r, b = min(x, ox), min(y, oy), max(r, ox + ow), max(b, oy + oh)
                best, members = max(best, confidence), members + 1
        out.append((i, x, y, r - x, b - y, best, members))
    return out


def group_nearby(boxes: DataFrame, by: tuple[str, ...] = ("y", "x"), line: float = 1.5, gap: float = 0.5) -> DataFrame:
    """Boxes of one line that lie close become one: in order, each box takes in every later one whose centre is within
    `line` mean heights and whose horizontal gap is below `gap` mean widths of the box as it has grown; its rectangle
    is the union and its confidence the largest. A row an image goes through Python, as the outcome depends on the order;
    nulls come last in it and never meet."""
    kept = ("x", "y", "w", "h", "confidence")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    order = [value(c).alias(f"by{k}") for k, c in enumerate(by)]
    each = F.struct(*order, F.col("box_id").isNull().alias("unnamed"), F.col("box_id").cast("int").alias("box_id"), *[value(c).alias(c) for c in kept])
    listed = boxes.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(F.sort_array(F.collect_list(each)).alias("all"))

    def merge(batches):
        for batch in batches:
            ends, cells = batch.column(1).offsets.to_pylist(), batch.column(1).values
            table = np.column_stack([cells.field(c).to_numpy() for c in kept])
            images, firsts, found = [], [], []
            for k, (start, end) in enumerate(zip(ends, ends[1:], strict=False)):
                for i, *box in _grown(table[start:end].tolist(), line, gap):
                    images.append(k)
                    firsts.append(start + i)
                    found.append(box)
            grown = np.array(found, np.float64).reshape(-1, 6)
            columns = [pa.array(grown[:, c], mask=np.isnan(grown[:, c])) for c in range(5)]
            own, named = batch.column(0).take(pa.array(images, pa.int64())), cells.field("box_id").take(pa.array(firsts, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, named, *columns, pa.array(grown[:, 5].astype(np.int64))], ["image_id", "box_id", *kept, "members"])

    return listed.mapInArrow(merge, "image_id long, box_id int, x double, y double, w double, h double, confidence double, members long")


def split_text_around_formulas(texts: DataFrame, formulas: DataFrame, min_width: float = 10.0) -> DataFrame:
    """What is left of text boxes between formulas of the same line: a theta join, then gaps of a running right edge."""
    t = texts.select("image_id", F.col("box_id").alias("text_id"), *[F.col(c).alias("t" + c) for c in "xywh"])
    f = formulas.select("image_id", *[F.col(c).alias("f" + c) for c in "xywh"])
    shared = F.least(F.col("ty") + F.col("th"), F.col("fy") + F.col("fh")) - F.greatest("ty", "fy")
    apart = F.greatest(F.col("fx") - (F.col("tx") + F.col("tw")), F.col("tx") - (F.col("fx") + F.col("fw")), F.lit(0.0))
    near = (shared > 0.6 * F.least("th", "fh")) & ((apart < 0.5 * F.col("tw")) | (apart < 50))
    meets = near & (F.col("fx") <= F.col("tx") + F.col("tw")) & (F.col("fx") + F.col("fw") >= F.col("tx"))
    cuts = t.join(f, "image_id").where(meets).select("image_id", "text_id", "tx", "ty", "tw", "th", F.col("fx").alias("s"), (F.col("fx") + F.col("fw")).alias("e"))
    ends = t.select("image_id", "text_id", "tx", "ty", "tw", "th", (F.col("tx") + F.col("tw")).alias("s"), F.lit(float("inf")).alias("e"))
    before = Window.partitionBy("image_id", "text_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    begun = cuts.unionByName(ends).withColumn("x", F.greatest("tx", F.coalesce(F.max("e").over(before), F.col("tx"))))
    return begun.where(F.col("s") - F.col("x") >= min_width).select("image_id", "text_id", "x", F.col("ty").alias("y"), (F.col("s") - F.col("x")).alias("w"), F.col("th").alias("h"))


def area_perimeter(points: DataFrame) -> DataFrame:
    """Shoelace area and closed perimeter of polygons (poly_id, ord, x, y); no area below three points."""
    order = Window.partitionBy("poly_id").orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_: dict[str, Column] = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in "xy"}
    edges = points.withColumns({"nx": next_["x"], "ny": next_["y"]})
    cross = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    far = F.sum(F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))))
    both = edges.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), cross.alias("cross"), far.alias("perimeter"))
    return both.select("poly_id", F.when(F.col("n") < 3, 0.0).otherwise(F.abs("cross") / 2).alias("area"), "perimeter")


def bounding_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("poly_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


def expand(points: DataFrame, distance: float = 4.0) -> DataFrame:
    """Points pushed away from their polygon's centroid, then cut to whole numbers towards zero; a point at the centroid stays."""
    whole = Window.partitionBy("poly_id")
    c = points.withColumns({"dx": F.col("x") - F.avg("x").over(whole), "dy": F.col("y") - F.avg("y").over(whole)})
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    pushed = lambda p, d: F.when(length > 0, F.col(p) + F.col(d) / length * distance).otherwise(F.col(p)).cast("int")
    return c.select("poly_id", "ord", pushed("x", "dx").alias("x"), pushed("y", "dy").alias("y"))


def unclip_distance(measured: DataFrame, ratio: float = 1.6) -> DataFrame:
    """How far a text region grows: area x ratio / perimeter; 0 without a perimeter."""
    return measured.withColumn("distance", F.when(F.col("perimeter") > 0, F.col("area") * ratio / F.col("perimeter")).otherwise(0.0))


def back_project(boxes: DataFrame, scale_x: float, scale_y: float, width: int, height: int) -> DataFrame:
    """Boxes of a scaled map on the image it shows: divided by the scales, cut to the image, those under a pixel left out."""
    x0, y0 = F.greatest(F.col("x") / scale_x, F.lit(0.0)), F.greatest(F.col("y") / scale_y, F.lit(0.0))
    x1 = F.least((F.col("x") + F.col("w")) / scale_x, F.lit(float(width)))
    y1 = F.least((F.col("y") + F.col("h")) / scale_y, F.lit(float(height)))
    return boxes.withColumns({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}).where((F.col("w") >= 1) & (F.col("h") >= 1))


def sure_regions(regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Regions whose mean probability is high enough."""
    return regions.where(F.col("score") >= least)
