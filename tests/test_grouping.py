"""Grouping of nearby boxes against the plain rule, image by image, and its cost for many small images."""

import math
import random

import pytest

from folioframe.operators import boxes

SCHEMA = "image_id long, box_id int, x double, y double, w double, h double, confidence double"


def plain(rows, by, line=1.5, gap=0.5):
    """The rule over one image's rows (box_id, x, y, w, h, confidence), nulls as NaN and last."""
    nan = float("nan")
    rows = [(r[0], *(nan if v is None else v for v in r[1:])) for r in rows]
    last = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
    rows.sort(key=lambda r: (*(last(r[{"x": 1, "y": 2}[c]]) for c in by), last(r[0])))
    used, out = set(), []
    for i, (box_id, x, y, w, h, best) in enumerate(rows):
        if i in used:
            continue
        r, b, members = x + w, y + h, 1
        for j, (_, ox, oy, ow, oh, confidence) in enumerate(rows):
            if j <= i or j in used:
                continue
            near = abs((y + b) / 2 - (oy + oh / 2)) <= line * (b - y + oh) / 2
            if near and max(ox - r, x - ox - ow, 0.0) < gap * (r - x + ow) / 2:
                used.add(j)
                x, y, r, b, best, members = min(x, ox), min(y, oy), max(r, ox + ow), max(b, oy + oh), max(best, confidence), members + 1
        out.append((box_id, *(None if math.isnan(v) else round(v, 9) for v in (x, y, r - x, b - y, best)), members))
    return out


@pytest.mark.parametrize("by", [("y", "x"), ("y",)])
def test_groups_are_those_of_the_rule(spark, by):
    rng = random.Random(5)
    number = lambda most: None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else rng.uniform(0, most)
    images = {i: [(k, number(400), number(200), number(60), number(30), number(1)) for k in range(rng.randrange(1, 30))] for i in (*range(60), None)}
    images[7].append((None, 3.0, 4.0, 5.0, 6.0, 0.5))
    df = spark.createDataFrame([(i, *r) for i, rows in images.items() for r in rows], SCHEMA).repartition(5)
    got = {}
    for r in boxes.group_nearby(df, by).collect():
        got.setdefault(r.image_id, []).append((r.box_id, *(None if v is None else round(v, 9) for v in (r.x, r.y, r.w, r.h, r.confidence)), r.members))
    key = lambda t: str(t)
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(plain(rows, by), key=key) for i, rows in images.items()}


def test_no_boxes_no_groups(spark):
    assert boxes.group_nearby(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_image_costs_no_python_call_of_its_own(spark):
    plan = boxes.group_nearby(spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
