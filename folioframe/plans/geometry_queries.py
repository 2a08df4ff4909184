"""Queries over boxes, polygons and model signals, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.fixtures import duck_sql, view
from folioframe.functions import geometry as g
from folioframe.operators import boxes as b
from folioframe.operators import signals as s


def _view(name):
    return lambda spark, sf: view(spark, sf, name)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


_INTER = "greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


def _inter(a, c):
    return _INTER.replace("{a}", a).replace("{b}", c)


def _union(a, c):
    return f"({a}.w * {a}.h + {c}.w * {c}.h - {_inter(a, c)})"


_PAIRS = "{v_boxes} a JOIN {v_boxes} c ON a.image_id = c.image_id AND a.box_id < c.box_id"
_NMS = f"""
WITH s AS (SELECT image_id, list({{'o': -confidence, 'box_id': box_id, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY -confidence, box_id) AS l FROM {{v_boxes}} b GROUP BY image_id),
r AS (SELECT image_id, unnest(list_reduce(list_transform(l, lambda z: [z]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: {_inter("k", "e[1]")} > 0.5 * {_union("k", "e[1]")})) > 0 THEN acc ELSE list_concat(acc, e) END)) AS k FROM s)
SELECT image_id, k.box_id AS box_id, round(-k.o, 6) AS confidence FROM r"""

def nms_sql(only: str | None = None) -> str:
    """(image_id, box_id) that suppression keeps, of one class or all."""
    return "(SELECT image_id, box_id FROM (" + (_NMS if only is None else _NMS.replace("{v_boxes} b GROUP", "{v_boxes} b WHERE class_name = '" + only + "' GROUP")) + ") nms)"


_SEG = """
WITH t AS (SELECT image_id, box_id AS text_id, x AS tx, y AS ty, w AS tw, h AS th FROM {v_boxes} b WHERE class_id = 0),
f AS (SELECT image_id, x AS fx, y AS fy, w AS fw, h AS fh FROM {v_boxes} b WHERE class_id = 1),
m AS (SELECT t.*, fx AS s, fx + fw AS e FROM t JOIN f ON t.image_id = f.image_id AND least(ty + th, fy + fh) - greatest(ty, fy) > 0.6 * least(th, fh)
  AND (greatest(fx - (tx + tw), tx - (fx + fw), 0.0) < 0.5 * tw OR greatest(fx - (tx + tw), tx - (fx + fw), 0.0) < 50) AND fx <= tx + tw AND fx + fw >= tx
  UNION ALL SELECT t.*, tx + tw, CAST('inf' AS DOUBLE) FROM t),
g AS (SELECT *, greatest(tx, coalesce(max(e) OVER (PARTITION BY image_id, text_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tx)) AS x FROM m)
SELECT image_id, text_id, x, ty AS y, s - x AS w, th AS h FROM g WHERE s - x >= 10"""

_POLY = """
WITH n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY poly_id ORDER BY ord), first_value(x) OVER (PARTITION BY poly_id ORDER BY ord)) AS nx, coalesce(lead(y) OVER (PARTITION BY poly_id ORDER BY ord), first_value(y) OVER (PARTITION BY poly_id ORDER BY ord)) AS ny FROM {v_points} p),
m AS (SELECT poly_id, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM n GROUP BY poly_id)
SELECT poly_id, round(area, 4) AS area, round(perimeter, 4) AS perimeter, round(area * 1.6 / perimeter, 4) AS distance FROM m"""


def _polygons(spark, sf):
    measured = b.unclip_distance(b.area_perimeter(view(spark, sf, "v_points")))
    return measured.select("poly_id", *[F.round(c, 4).alias(c) for c in ("area", "perimeter", "distance")])


def _expanded(spark, sf):
    return b.expand(view(spark, sf, "v_points"))


_EXPAND = """
SELECT poly_id, ord, CAST(trunc(CASE WHEN l > 0 THEN x + dx / l * 4.0 ELSE x END) AS INTEGER) AS x, CAST(trunc(CASE WHEN l > 0 THEN y + dy / l * 4.0 ELSE y END) AS INTEGER) AS y
FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM (SELECT *, x - avg(x) OVER (PARTITION BY poly_id) AS dx, y - avg(y) OVER (PARTITION BY poly_id) AS dy FROM {v_points} p) q) r"""

_DECODE = """
SELECT image_id, anchor AS box_id, greatest(0.0, (cx - w / 2 - 3) / 2) AS x, greatest(0.0, (cy - h / 2 - 5) / 2) AS y, w / 2 AS w, h / 2 AS h, round(greatest(s0, s1), 6) AS confidence,
  CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS class_id, CASE WHEN s1 > s0 THEN 'isolated' ELSE 'embedding' END AS class_name
FROM (SELECT *, 1 / (1 + exp(-c0)) AS s0, 1 / (1 + exp(-c1)) AS s1 FROM {v_anchors} a) z WHERE greatest(s0, s1) >= 0.4"""

_CTC_KEYS = {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "中"}
_STEPS = "(SELECT seq_id, t, list(x ORDER BY v) AS l FROM {v_logits} z GROUP BY seq_id, t)"
_CTC = f"""
WITH k AS (SELECT seq_id, t, list_position(l, list_max(l)) - 1 AS id FROM {_STEPS} s),
p AS (SELECT *, lag(id, 1, -1) OVER (PARTITION BY seq_id ORDER BY t) AS before FROM k),
c AS (SELECT seq_id, t, CASE WHEN id <> 0 AND id <> before THEN CASE id WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 4 THEN 'd' WHEN 5 THEN 'e' WHEN 6 THEN '中' END END AS c FROM p)
SELECT seq_id, coalesce(string_agg(c, '' ORDER BY t), '') AS text, CASE WHEN count(c) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM c GROUP BY seq_id"""

_TOKENS = "SELECT seq_id, t AS pos, CAST((floor(abs(x) * 1000) + v) AS BIGINT) % 8 AS id FROM {v_logits} z WHERE v = 3"
_DETOK = """
WITH v AS (SELECT * FROM (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, 'Ġthe'), (4, 'frac'), (5, '{{'), (6, 'Ġx'), (7, '}}')) q(id, token)),
t AS (TOKENS), e AS (SELECT *, max(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS ended FROM t)
SELECT seq_id, coalesce(string_agg(replace(token, 'Ġ', ' '), '' ORDER BY pos) FILTER (WHERE ended = 0 AND id > 2), '') AS text FROM e LEFT JOIN v USING (id) GROUP BY seq_id""".replace("{{", "{").replace("}}", "}")


def _tokens(spark, sf):
    from folioframe.fixtures import spark_sql

    vocabulary = spark.createDataFrame([(0, "<s>"), (1, "<pad>"), (2, "</s>"), (3, "Ġthe"), (4, "frac"), (5, "{"), (6, "Ġx"), (7, "}")], "id long, token string")
    return s.detokenize(spark_sql(spark, sf, _TOKENS), vocabulary)


def _softmax(spark, sf):
    made = s.steps(view(spark, sf, "v_logits")).withColumn("p", s.softmax("logits"))
    return made.select("seq_id", "t", F.posexplode("p").alias("v", "p")).select("seq_id", "t", "v", F.round("p", 9).alias("p"))


_BANDS_ROWS = """
WITH lim AS (SELECT image_id, least(greatest(l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] - 28, 80), 245) AS m FROM (SELECT image_id, list(gray ORDER BY gray) AS l FROM {v_gray} z GROUP BY image_id) q),
ink AS (SELECT g.image_id, g.r, count(*) FILTER (WHERE g.gray < m) AS ink FROM {v_gray} g JOIN lim USING (image_id) GROUP BY g.image_id, g.r)"""
_BANDS = _BANDS_ROWS + """,
isl AS (SELECT image_id, r, r - row_number() OVER (PARTITION BY image_id ORDER BY r) AS k FROM ink WHERE ink >= 3),
band AS (SELECT image_id, min(r) AS top, max(r) AS bottom FROM isl GROUP BY image_id, k)"""
_MERGED = _BANDS + """,
new AS (SELECT *, CASE WHEN top > lag(bottom) OVER (PARTITION BY image_id ORDER BY top) + 2 OR lag(bottom) OVER (PARTITION BY image_id ORDER BY top) IS NULL THEN 1 ELSE 0 END AS n FROM band),
part AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY top) AS p FROM new)
SELECT image_id, min(top) AS top, max(bottom) AS bottom FROM part GROUP BY image_id, p"""


def _dims(spark, sf):
    width, resized = s.recognition_width(F.col("w"), F.col("h"))
    v = view(spark, sf, "v_boxes")
    scale = F.least(F.lit(768.0) / (F.col("w") * 20), F.lit(768.0) / (F.col("h") * 20), F.lit(1.0))
    side = F.least(F.lit(1.0), 960 / F.greatest(F.col("w") * 20, F.col("h") * 20))
    stride = lambda c: (F.ceil(F.round(F.col(c) * 20 * side) / 32) * 32).cast("int")
    pad = lambda c: F.floor((768 - F.floor(F.col(c) * 20 * scale)) / 2).cast("int")
    return v.select("image_id", "box_id", width.alias("tensor_w"), resized.alias("resized_w"), F.round(scale, 9).alias("scale"), pad("w").alias("pad_x"), pad("h").alias("pad_y"), stride("w").alias("stride_w"), stride("h").alias("stride_h"))


_DIMS = """
SELECT image_id, box_id, CAST(floor(48 * greatest(320.0::DOUBLE / 48, w / h) + 0.5) AS INTEGER) AS tensor_w, CAST(least(ceil(48 * w / h), floor(48 * greatest(320.0::DOUBLE / 48, w / h) + 0.5)) AS INTEGER) AS resized_w,
 round(sc, 9) AS scale, CAST(floor((768 - floor(w * 20 * sc)) / 2) AS INTEGER) AS pad_x, CAST(floor((768 - floor(h * 20 * sc)) / 2) AS INTEGER) AS pad_y,
 CAST(ceil(round(w * 20 * sd) / 32) * 32 AS INTEGER) AS stride_w, CAST(ceil(round(h * 20 * sd) / 32) * 32 AS INTEGER) AS stride_h
FROM (SELECT *, least(768.0::DOUBLE / (w * 20), 768.0::DOUBLE / (h * 20), 1.0::DOUBLE) AS sc, least(1.0::DOUBLE, 960 / greatest(w * 20, h * 20)) AS sd FROM {v_boxes} b) z"""

QUERIES = {
    "geo_iou_pairs": (
        lambda sp, sf: b.pairs(view(sp, sf, "v_boxes")).select("image_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), F.round(g.iou(F.col("a"), F.col("b")), 6).alias("iou")),
        f"SELECT a.image_id, a.box_id AS a_id, c.box_id AS b_id, round(CASE WHEN {_union('a', 'c')} > 0 THEN {_inter('a', 'c')} / {_union('a', 'c')} ELSE 0.0 END, 6) AS iou FROM {_PAIRS}",
    ),
    "geo_overlap_join": (
        lambda sp, sf: b.pairs(view(sp, sf, "v_boxes")).where(g.overlaps(F.col("a"), F.col("b"))).select("image_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id")),
        f"SELECT a.image_id, a.box_id AS a_id, c.box_id AS b_id FROM {_PAIRS} WHERE a.x < c.x + c.w AND a.x + a.w > c.x AND a.y < c.y + c.h AND a.y + a.h > c.y",
    ),
    "geo_contains": (
        lambda sp, sf: view(sp, sf, "v_boxes").select("image_id", "box_id", g.right(g.rect()).alias("r"), g.bottom(g.rect()).alias("b"), g.center_x(g.rect()).alias("cx"), g.center_y(g.rect()).alias("cy"), g.contains(g.rect(), F.lit(60.0), F.lit(40.0)).alias("inside")),
        "SELECT image_id, box_id, x + w AS r, y + h AS b, x + w / 2 AS cx, y + h / 2 AS cy, (60.0 >= x AND 60.0 <= x + w AND 40.0 >= y AND 40.0 <= y + h) AS inside FROM {v_boxes} b",
    ),
    "geo_polygon_area_perimeter": (_polygons, _POLY),
    "geo_bbox": (lambda sp, sf: b.bounding_boxes(view(sp, sf, "v_points")), "SELECT poly_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM {v_points} p GROUP BY poly_id"),
    "geo_expand": (_expanded, _EXPAND),
    "det_decode_yolo": (lambda sp, sf: _rounded(b.decode_anchors(view(sp, sf, "v_anchors"), 0.4, 2.0, 3.0, 5.0), "confidence"), _DECODE),
    "det_sigmoid": (lambda sp, sf: view(sp, sf, "v_anchors").select("image_id", "anchor", F.round(g.sigmoid(F.col("c0")), 9).alias("s")), "SELECT image_id, anchor, round(1 / (1 + exp(-c0)), 9) AS s FROM {v_anchors} a"),
    "det_nms": (lambda sp, sf: b.suppress(view(sp, sf, "v_boxes")).select("image_id", "box_id", F.round("confidence", 6).alias("confidence")), _NMS),
    "det_top50": (lambda sp, sf: b.most_confident(view(sp, sf, "v_boxes"), 3).select("image_id", "box_id", "place"), "SELECT * FROM (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS place FROM {v_boxes} b) z WHERE place <= 3"),
    "det_filter": (lambda sp, sf: b.large_and_sure(view(sp, sf, "v_boxes"), 2500.0, 0.9).select("image_id", "box_id", "w", "h"), "SELECT image_id, box_id, w, h FROM {v_boxes} b WHERE w * h >= 2500 AND confidence >= 0.9"),
    "det_reading_order": (lambda sp, sf: b.reading_order(view(sp, sf, "v_boxes")).select("image_id", "box_id", "place"), "SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS place FROM {v_boxes} b"),
    "det_group": (lambda sp, sf: b.group_nearby(view(sp, sf, "v_boxes")), None),
    "tdet_merge": (lambda sp, sf: b.group_nearby(view(sp, sf, "v_boxes"), by=("y",)), None),
    "seg_split_text": (lambda sp, sf: (lambda v: b.split_text_around_formulas(v.where("class_id = 0"), v.where("class_id = 1")))(view(sp, sf, "v_boxes")), _SEG),
    "dec_ctc": (lambda sp, sf: s.ctc(s.steps(view(sp, sf, "v_logits")), _CTC_KEYS), _CTC),
    "dec_softmax": (_softmax, f"SELECT seq_id, t, CAST(v AS INTEGER) AS v, round(p, 9) AS p FROM (SELECT seq_id, t, unnest(range(len(l))) AS v, unnest(list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l)))))) AS p FROM {_STEPS} s) z"),
    "dec_argmax_last": (
        lambda sp, sf: s.steps(view(sp, sf, "v_logits")).select("seq_id", "t", s.first_argmax("logits").alias("first"), s.last_argmax("logits").alias("last")),
        f"SELECT seq_id, t, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS first, CAST(len(l) - list_position(list_reverse(l), list_max(l)) AS INTEGER) AS last FROM {_STEPS} s",
    ),
    "dec_greedy": (
        lambda sp, sf: s.greedy_sequences(s.steps(view(sp, sf, "v_logits"))).select("seq_id", F.array_join("ids", ",").alias("ids")),
        f"WITH k AS (SELECT seq_id, t, len(l) - list_position(list_reverse(l), list_max(l)) AS id FROM {_STEPS} s), e AS (SELECT *, max(CASE WHEN id IN (0, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t) AS ended FROM k) SELECT seq_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY t) FILTER (WHERE ended = 0), '') AS ids FROM e GROUP BY seq_id",
    ),
    "tok_decode": (_tokens, _DETOK.replace("TOKENS", _TOKENS)),
    "rec_width": (_dims, _DIMS),
    "tdet_back_project": (
        lambda sp, sf: _rounded(b.back_project(view(sp, sf, "v_boxes"), 0.5, 0.8, 300, 100), "x", "y", "w", "h").select("image_id", "box_id", "x", "y", "w", "h"),
        "SELECT image_id, box_id, round(a, 6) AS x, round(b, 6) AS y, round(c - a, 6) AS w, round(d - b, 6) AS h FROM (SELECT image_id, box_id, greatest(x / 0.5, 0) AS a, greatest(y / 0.8, 0) AS b, least((x + w) / 0.5, 300) AS c, least((y + h) / 0.8, 100) AS d FROM {v_boxes} q) z WHERE c - a >= 1 AND d - b >= 1",
    ),
    "tdet_score_filter": (
        lambda sp, sf: b.sure_regions(s.mean_inside(view(sp, sf, "v_logits").withColumn("x", g.sigmoid(F.col("x"))), 1, 2, 6, 5)).select("seq_id"),
        "SELECT seq_id FROM {v_logits} z GROUP BY seq_id HAVING coalesce(avg(1 / (1 + exp(-x))) FILTER (WHERE v >= 1 AND v < 6 AND t >= 2 AND t < 5), 0.0) >= 0.5",
    ),
    "tdet_binarize": (
        lambda sp, sf: view(sp, sf, "v_logits").select("seq_id", "t", "v", (g.sigmoid(F.col("x")) > 0.5).alias("on")),
        "SELECT seq_id, t, v, 1 / (1 + exp(-x)) > 0.5 AS on FROM {v_logits} z",
    ),
    "tdet_avg_score": (
        lambda sp, sf: s.mean_inside(view(sp, sf, "v_logits"), 1, 2, 6, 5).select("seq_id", F.round("score", 9).alias("score")),
        "SELECT seq_id, round(coalesce(avg(x) FILTER (WHERE v >= 1 AND v < 6 AND t >= 2 AND t < 5), 0.0), 9) AS score FROM {v_logits} z GROUP BY seq_id",
    ),
    "line_ink_rows": (lambda sp, sf: s.ink_rows(view(sp, sf, "v_gray"), border=False).drop("height", "width"), _BANDS_ROWS + " SELECT image_id, r, ink FROM ink"),
    "line_row_bands": (lambda sp, sf: s.bands(s.ink_rows(view(sp, sf, "v_gray"), border=False)).drop("height"), _BANDS + " SELECT image_id, top, bottom FROM band"),
    "line_merge_bands": (lambda sp, sf: s.merge_bands(s.bands(s.ink_rows(view(sp, sf, "v_gray"), border=False)), 2).drop("height"), _MERGED),
}
SQL = {name: duck_sql(sql) for name, (_, sql) in QUERIES.items() if sql}
