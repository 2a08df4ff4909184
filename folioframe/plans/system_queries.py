"""Queries over conversions, pipelines, jobs, sources and images, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.fixtures import duck_sql, view
from folioframe.functions import symbols
from folioframe.operators import convert as c
from folioframe.operators import documents as d
from folioframe.operators import images as im
from folioframe.operators import recognize as r
from folioframe.plans import engine, flagship, graph
from folioframe.plans.geometry_queries import nms_sql
from folioframe.session import table
from folioframe.sources import models


def _round_trip(through):
    def run(sp, sf):
        first = c.convert_formulas(view(sp, sf, "v_formulas"), "latex", "latex", (through,)).select("formula_id", "result")
        return c.convert_formulas(first.where("result IS NOT NULL"), "result", through, ("latex",)).select("formula_id", "result", "error")

    return run


def _convert(*targets):
    return lambda sp, sf: c.convert_formulas(view(sp, sf, "v_formulas"), "latex", "latex", targets)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SYMBOLS = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in symbols.rows()) + ') s(latex, unicode, typst, "class")'
_HEX = "CASE lower(n) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in symbols.COLORS.items()) + " ELSE '000000' END"


def _colors(sp, sf):
    names = sp.createDataFrame([(x,) for x in ("red", " Blue ", "#00ff00", "abcdef", "nothing", "teal")], "name string")
    return names.select("name", c.color_hex(F.col("name")).alias("hex"))


_COLORS = f"SELECT name, CASE WHEN regexp_full_match(n, '[0-9A-Fa-f]{{6}}') THEN upper(n) ELSE {_HEX} END AS hex FROM (SELECT name, regexp_replace(trim(name), '^#', '') AS n FROM (VALUES ('red'), (' Blue '), ('#00ff00'), ('abcdef'), ('nothing'), ('teal')) v(name)) q"


def _gray_images(sp, sf):
    from pyspark.sql import functions as F

    cells = view(sp, sf, "v_gray").withColumn("b", F.unhex(F.lpad(F.hex("gray"), 2, "0")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", F.hex("b").alias("h")))), lambda x: x.h)
    return cells.groupBy("image_id").agg(F.unhex(F.array_join(ordered, "")).alias("pixels")).select("image_id", F.lit(4).alias("width"), F.lit(16).alias("height"), F.lit("gray").alias("format"), "pixels")


def _digest(df):
    return df.select("image_id", "width", "height", "format", F.hex("pixels").alias("pixels"))


def _pixels(sp, sf, change):
    return _digest(im.map_images(_gray_images(sp, sf), change))


_RESIZED = "SELECT image_id, CAST(2 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, 'gray' AS format, string_agg(printf('%02X', gray), '' ORDER BY r, c) AS pixels FROM {v_gray} g WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY image_id"
_CROPPED = "SELECT image_id, CAST(2 AS INTEGER) AS width, CAST(3 AS INTEGER) AS height, 'gray' AS format, string_agg(printf('%02X', gray), '' ORDER BY r, c) AS pixels FROM {v_gray} g WHERE r BETWEEN 2 AND 4 AND c BETWEEN 1 AND 2 GROUP BY image_id"


def _maps(sp, sf, find, schema):
    import numpy as np
    import pandas as pd

    def run(frame):
        p = np.zeros((8, 8))
        p[frame.t, frame.v] = 1 / (1 + np.exp(-40 * frame.x))
        return pd.DataFrame([(int(frame.seq_id.iloc[0]), i, *x) for i, x in enumerate(find(p))], columns=[x.split(" ")[0] for x in schema.split(", ")])

    return view(sp, sf, "v_logits").groupBy("seq_id").applyInPandas(run, schema)


def _checksums(sp, sf):
    files = table(sp, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    sums = files.where("CAST(path AS BIGINT) % 3 > 0").select("path", F.when(F.col("path").cast("long") % 3 == 1, F.sha2("content", 256)).otherwise("0").alias("sha256"))
    return models.verify_checksums(files, sums)


def _candidates(sp, sf):
    rows = [("a", "inference.onnx"), ("a", "model.onnx"), ("b", "other.onnx"), ("b", "another.onnx"), ("c", "readme.txt"), ("d", "model_quantized.onnx"), ("d", "z.onnx")]
    return models.first_candidate(sp.createDataFrame(rows, "dir string, file string"), models.MODEL_FILES)


def _requests(sp, sf):
    p = view(sp, sf, "v_boxes").withColumn("size", (F.col("w") * F.col("h") * F.when(F.col("class_id") == 1, 3).otherwise(2)).cast("long"))
    return p.select("image_id", "box_id", models.valid_request(F.col("w"), F.col("h"), F.col("size")).alias("ok"))


_MERGE = "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, rank, box_id) AS place FROM (SELECT image_id, box_id, y, CASE WHEN class_id = 1 THEN 0 ELSE 1 END AS rank FROM {v_boxes} b) z"
_ITEMS = "SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS INTEGER) AS seq, 'region_recognized' AS item, CAST(box_id AS INTEGER) AS box_id, confidence FROM {v_boxes} b UNION ALL SELECT image_id, CAST(count(*) + 1 AS INTEGER), 'completed', NULL, NULL FROM {v_boxes} b GROUP BY image_id"
_LIMITED = "SELECT image_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS p FROM {v_boxes} b WHERE confidence >= 0.9) z WHERE p <= 2"


def _split(v, kind):
    return v.where(F.col("class_id") == kind)


#: Kahn's order with the least name first, for the manifests of v_nodes: dependencies first, depth by depth.
_ORDERS = """WITH RECURSIVE bad AS (SELECT n.pipeline, n.name || ' depends on ' || n.dep || ', which is not there' AS error FROM {v_nodes} n WHERE n.dep <> '' AND NOT EXISTS (SELECT 1 FROM {v_nodes} m WHERE m.pipeline = n.pipeline AND m.name = n.dep)),
 reach AS (SELECT pipeline, name AS a, dep AS b FROM {v_nodes} n WHERE dep <> '' UNION SELECT r.pipeline, r.a, n.dep FROM reach r JOIN {v_nodes} n ON n.pipeline = r.pipeline AND n.name = r.b WHERE n.dep <> ''),
 loops AS (SELECT pipeline, 'cycle among ' || string_agg(DISTINCT a, ', ' ORDER BY a) AS error FROM reach WHERE a = b GROUP BY pipeline),
 deep AS (SELECT pipeline, name, 0 AS k FROM {v_nodes} n WHERE dep = '' UNION SELECT n.pipeline, n.name, k + 1 FROM deep JOIN {v_nodes} n ON n.pipeline = deep.pipeline AND n.dep = deep.name WHERE k < 100)
 SELECT pipeline, -1 AS place, NULL AS name, error FROM bad UNION ALL SELECT pipeline, -1, NULL, error FROM loops
 UNION ALL SELECT pipeline, CAST(row_number() OVER (PARTITION BY pipeline ORDER BY k, name) - 1 AS INTEGER), name, NULL FROM (SELECT pipeline, name, max(k) AS k FROM deep GROUP BY pipeline, name) z WHERE pipeline NOT IN (SELECT pipeline FROM bad UNION SELECT pipeline FROM loops)"""
_GRID = "(SELECT image_id, h, w FROM (SELECT DISTINCT image_id FROM {v_gray} g) i CROSS JOIN (SELECT unnest(range(%d)) AS h) y CROSS JOIN (SELECT unnest(range(%d)) AS w) x)"
_PADDED = "SELECT p.image_id, CAST(5 AS INTEGER) AS width, CAST(20 AS INTEGER) AS height, 'gray' AS format, string_agg(printf('%02X', coalesce(gray, 0)), '' ORDER BY h, w) AS pixels FROM " + _GRID % (20, 5) + " p LEFT JOIN {v_gray} g ON g.image_id = p.image_id AND r = h AND c = w GROUP BY p.image_id"
#: 4 x 16 pixels onto 11 x 11: scale 11/16, so 2.75 rounds to 3 columns, 4 to the left of them.
_LETTERBOX = "SELECT p.image_id, CAST(11 AS INTEGER) AS width, CAST(11 AS INTEGER) AS height, 'gray' AS format, string_agg(printf('%02X', coalesce(gray, 114)), '' ORDER BY h, w) AS pixels FROM " + _GRID % (11, 11) + " p LEFT JOIN {v_gray} g ON g.image_id = p.image_id AND w BETWEEN 4 AND 4 + round(4 * 11 / 16.0) - 1 AND r = h * 16 // 11 AND c = (w - 4) * 4 // CAST(round(4 * 11 / 16.0) AS BIGINT) GROUP BY p.image_id"


_SURE = "WHERE w * h >= 100 AND confidence >= 0.2"
#: Boxes that survive suppression and filters, in reading order, with the formula that the mock gives each.
_PAGES = f"""SELECT image_id AS doc_id, string_agg(CASE WHEN class_name = 'isolated' THEN '$$' || latex || '$$' ELSE '$' || latex || '$' END, chr(10) || chr(10) ORDER BY place) AS body
 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS place, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS nth FROM {nms_sql()} n JOIN {{v_boxes}} b USING (image_id, box_id) {_SURE}) z
 JOIN {{v_formulas}} f ON f.formula_id = (image_id + nth) % (SELECT max(formula_id) FROM {{v_formulas}} g) + 1 GROUP BY image_id"""


def _regions_sql(*kinds: tuple[str, int]) -> str:
    each = [f"SELECT image_id, box_id, y, {rank} AS rank FROM {nms_sql(name)} n JOIN {{v_boxes}} b USING (image_id, box_id) {_SURE}" for name, rank in kinds]
    return f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, rank, box_id) AS place FROM ({' UNION ALL '.join(each)}) z"


_NAMED = f"""SELECT f.formula_id, coalesce(string_agg(s.unicode, '' ORDER BY i), '') AS symbols FROM {{v_formulas}} f
 LEFT JOIN (SELECT formula_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT formula_id, regexp_extract_all(latex, '\\\\[A-Za-z]+') AS l FROM {{v_formulas}} g) q) u ON u.formula_id = f.formula_id LEFT JOIN ({_SYMBOLS}) s ON s.latex = u.c GROUP BY f.formula_id"""


def _rgba_images(sp, sf):
    """The same pixels as 4 x 4 images of four channels: v_gray's row is the pixel, its column the channel."""
    return _gray_images(sp, sf).select("image_id", F.lit(4).alias("width"), F.lit(4).alias("height"), F.lit("rgba").alias("format"), "pixels")


_CHANNELS = "SELECT image_id, CAST(4 AS INTEGER) AS width, CAST(4 AS INTEGER) AS height, '{kind}' AS format, string_agg(printf('%02X', gray), '' ORDER BY r, {order}) AS pixels FROM {{v_gray}} g WHERE c < {n} GROUP BY image_id"
_LISTING = [("m/b", "inference.yml"), ("m/b", "inference.onnx"), ("m/a", "config.json"), ("m/a", "keys.txt"), ("m/a", "model.onnx"), ("n/x", "model.onnx")]


def _listing(sp):
    return sp.createDataFrame(_LISTING, "dir string, file string")


def _formatted(sp, sf):
    """Formula blocks, every third of another format."""
    return view(sp, sf, "v_blocks").withColumn("format", F.when(F.col("ord") % 3 == 0, "mathml").otherwise("latex"))


def _normalized(sp, sf):
    found = im.normalized(_gray_images(sp, sf), [0.485], [0.229])
    return found.select("image_id", F.posexplode("values").alias("i", "x")).select("image_id", F.expr("cast(i div 4 as bigint)").alias("r"), (F.col("i") % 4).cast("long").alias("c"), F.round(F.col("x").cast("double"), 3).alias("v"))


QUERIES = {
    "page_markdown": (flagship.page_markdown, _PAGES),
    "conv_formulas_all": (_convert(*c.FORMATS), None),
    "conv_mathml": (_convert("mathml"), None),
    "conv_mathml_mml": (_convert("mathml_mml"), None),
    "conv_mathml_m": (_convert("mathml_m"), None),
    "conv_mathml_attr": (_convert("mathml_attr"), None),
    "conv_omml": (_convert("omml"), None),
    "conv_typst_formulas": (_convert("typst"), None),
    "roundtrip_mathml": (_round_trip("mathml"), None),
    "roundtrip_omml": (_round_trip("omml"), None),
    "roundtrip_typst": (_round_trip("typst"), None),
    "latex_tree": (lambda sp, sf: c.expand(view(sp, sf, "v_formulas"), "formula_id", "latex", c.FormulaNodes), None),
    "latex_parse": (lambda sp, sf: c.expand(view(sp, sf, "v_formulas").withColumn("latex", F.concat(F.lit("so $x$ and $$"), "latex", F.lit("$$ end"))), "formula_id", "latex", c.LatexBlocks), None),
    "md_parse": (lambda sp, sf: c.expand(table(sp, sf, "documents"), "doc_id", "text", c.MarkdownBlocks), None),
    "conv_symbols": (lambda sp, sf: c.symbol_table(sp), _SYMBOLS),
    "conv_name_symbols": (lambda sp, sf: c.name_symbols(view(sp, sf, "v_formulas"), "latex").select("formula_id", F.array_join("symbols", "").alias("symbols")), _NAMED),
    "conv_colors": (_colors, _COLORS),
    "pipe_toposort": (lambda sp, sf: graph.orders(view(sp, sf, "v_nodes")), _ORDERS),
    "pipe_missing_deps": (lambda sp, sf: graph.missing_dependencies(view(sp, sf, "v_nodes")), "SELECT n.pipeline, n.name, n.dep FROM {v_nodes} n WHERE n.dep <> '' AND NOT EXISTS (SELECT 1 FROM {v_nodes} m WHERE m.pipeline = n.pipeline AND m.name = n.dep)"),
    "pipe_cycles": (lambda sp, sf: graph.cyclic_pipelines(view(sp, sf, "v_nodes")), "WITH RECURSIVE r AS (SELECT pipeline, name AS a, dep AS b FROM {v_nodes} n WHERE dep <> '' UNION SELECT r.pipeline, r.a, n.dep FROM r JOIN {v_nodes} n ON n.pipeline = r.pipeline AND n.name = r.b WHERE n.dep <> '') SELECT DISTINCT pipeline FROM r WHERE a = b"),
    "pipe_run": (engine.run, _regions_sql(("isolated", 0), ("embedding", 1))),
    "pipe_run_formula": (lambda sp, sf: engine.run(sp, sf, "formula"), _regions_sql(("isolated", 0))),
    "line_groups": (lambda sp, sf: _maps(sp, sf, lambda p: [(len(g),) for g in im.line_groups((255 * (1 - p.repeat(4, 0).repeat(4, 1)[:, :, None])).astype("uint8"))], "seq_id long, n int, rows int"), None),
    "job_last_status": (lambda sp, sf: graph.last_status(view(sp, sf, "v_jobs")), "SELECT job_id, arg_max(status, seq) AS status, count(*) AS n FROM {v_jobs} j GROUP BY job_id"),
    "job_queue_counts": (lambda sp, sf: graph.queue_counts(view(sp, sf, "v_jobs")), "SELECT status, count(*) AS jobs FROM (SELECT job_id, arg_max(status, seq) AS status FROM {v_jobs} j GROUP BY job_id) z GROUP BY status"),
    "job_next": (lambda sp, sf: graph.next_jobs(view(sp, sf, "v_jobs")), "SELECT job_id, first_event FROM (SELECT job_id, arg_max(status, seq) AS status, min(event_id) AS first_event FROM {v_jobs} j GROUP BY job_id) z WHERE status = 'pending'"),
    "event_bus_filter": (lambda sp, sf: table(sp, sf, "events").where("event_type = 'error'").select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'error'"),
    "eng_merge_regions": (lambda sp, sf: (lambda v: r.merge_regions(_split(v, 1), _split(v, 0)))(view(sp, sf, "v_boxes")), _MERGE),
    "eng_limited_request": (lambda sp, sf: r.limited(view(sp, sf, "v_boxes"), 2, 0.9).select("image_id", "box_id"), _LIMITED),
    "stream_items": (lambda sp, sf: r.stream_items(view(sp, sf, "v_boxes")), _ITEMS),
    "mock_recognition": (
        lambda sp, sf: r.mock_recognition(view(sp, sf, "v_boxes"), view(sp, sf, "v_formulas")).drop("class_id"),
        "SELECT image_id, box_id, x, y, w, h, confidence, class_name, latex, class_name = 'isolated' AS display FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS nth FROM {v_boxes} b) z JOIN {v_formulas} f ON f.formula_id = (image_id + nth) % (SELECT max(formula_id) FROM {v_formulas} g) + 1",
    ),
    "src_checksum": (_checksums, "SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 3 <> 2 AS ok FROM documents"),
    "src_candidates": (_candidates, "SELECT * FROM (VALUES ('a', 'model.onnx'), ('b', 'another.onnx'), ('d', 'model_quantized.onnx')) v(dir, file)"),
    "bind_validate": (_requests, "SELECT image_id, box_id, class_id = 1 AS ok FROM {v_boxes} b"),
    "img_resize": (lambda sp, sf: _pixels(sp, sf, lambda a: im.resize(a, 2, 8)), _RESIZED),
    "img_crop": (lambda sp, sf: _pixels(sp, sf, lambda a: im.crop(a, 1.4, 1.6, 2, 3)), _CROPPED),
    "img_pad_to_stride": (lambda sp, sf: _pixels(sp, sf, lambda a: im.pad_to_stride(a, 5)), _PADDED),
    "img_letterbox": (lambda sp, sf: _pixels(sp, sf, lambda a: im.letterbox(a, 11)[0]), _LETTERBOX),
    "img_swap_red_blue": (lambda sp, sf: _digest(im.map_images(_rgba_images(sp, sf), im.swap_red_blue)), _CHANNELS.format(kind="rgba", n=4, order="CASE c WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE c END")),
    "img_drop_alpha": (lambda sp, sf: _digest(im.map_images(_rgba_images(sp, sf), im.drop_alpha)), _CHANNELS.format(kind="rgb", n=3, order="c")),
    "img_resize_to_fit": (lambda sp, sf: _pixels(sp, sf, lambda a: im.resize_to_fit(a, 8)), _RESIZED),
    "img_png_roundtrip": (lambda sp, sf: _digest(im.map_images(_rgba_images(sp, sf), lambda a: im.decode(im.encode_png(a)))), _CHANNELS.format(kind="rgba", n=4, order="c")),
    "src_exported": (lambda sp, sf: models.exported_recognizers(_listing(sp)).select("dir", "height", "width", "color_format"), "SELECT 'm/b' AS dir, 48 AS height, 3200 AS width, 'bgr' AS color_format"),
    "src_text_model": (lambda sp, sf: models.text_model(_listing(sp), ["m/", "n/"]), "SELECT 'm/' AS root, 'm/a' AS dir, 'model.onnx' AS model"),
    "doc_as_latex": (lambda sp, sf: d.as_latex(_formatted(sp, sf)).select("doc_id", "ord", "latex"), "SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN '' ELSE text END AS latex FROM {v_blocks} b WHERE kind = 'formula'"),
    "doc_places": (
        lambda sp, sf: d.places(view(sp, sf, "v_boxes").select(F.col("image_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("box_id").alias("ord"), *"xywh", "confidence")).drop("source"),
        "SELECT image_id AS doc_id, CAST(0 AS INTEGER) AS page_idx, box_id AS ord, x, y, w, h, confidence FROM {v_boxes} b",
    ),
    "img_normalize": (_normalized, "SELECT image_id, r, c, round((gray / 255.0 - 0.485) / 0.229, 3) AS v FROM {v_gray} g"),
    "img_pixel": (lambda sp, sf: _gray_images(sp, sf).select("image_id", im.pixel_at("pixels", 2, 5, 4).alias("gray")), "SELECT image_id, gray FROM {v_gray} g WHERE r = 5 AND c = 2"),
    "tdet_components": (lambda sp, sf: _maps(sp, sf, lambda p: im.components(p), "seq_id long, n int, x int, y int, w int, h int, pixels int"), None),
    "tdet_contours": (lambda sp, sf: _maps(sp, sf, lambda p: [(len(x), min(q[0] for q in x), min(q[1] for q in x)) for x in im.contours(p)], "seq_id long, n int, points int, x int, y int"), None),
}
SQL = {name: duck_sql(sql) for name, (_, sql) in QUERIES.items() if sql}
