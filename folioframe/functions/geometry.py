"""Rectangles as structs of x, y, w, h: column functions that Catalyst sees through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(prefix: str = "") -> Column:
    """A rectangle from columns <prefix>x, y, w, h."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in "xywh"])


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def center_x(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def center_y(r: Column) -> Column:
    return r["y"] + r["h"] / 2


def intersection(a: Column, b: Column) -> Column:
    """Area that both cover."""
    across = F.greatest(F.lit(0.0), F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0.0), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]))
    return across * down


def union(a: Column, b: Column) -> Column:
    """Area that either covers."""
    return a["w"] * a["h"] + b["w"] * b["h"] - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    return F.when(union(a, b) > 0, intersection(a, b) / union(a, b)).otherwise(0.0)


def contains(r: Column, x: Column, y: Column) -> Column:
    """All four edges belong to the rectangle."""
    return (x >= r["x"]) & (x <= right(r)) & (y >= r["y"]) & (y <= bottom(r))


def overlaps(a: Column, b: Column) -> Column:
    """Rectangles that only touch do not overlap."""
    return (a["x"] < right(b)) & (right(a) > b["x"]) & (a["y"] < bottom(b)) & (bottom(a) > b["y"])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
