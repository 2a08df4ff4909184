"""Inputs of the document operators, derived from the given tables by SQL that Spark and DuckDB both run.

A view's text names tables in braces; `spark_view` and `duck_view` fill them in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BOXES = """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ln, pk, sk, ep, q, d, t) AS box_id,
       CAST((pk * 37) % 200 AS DOUBLE) AS x, CAST((sk * 53) % 100 AS DOUBLE) AS y, 20 + 2 * q AS w, 20 + q AS h,
       1 - t - d AS confidence, CASE WHEN ls = 'O' THEN 1 ELSE 0 END AS class_id,
       CASE WHEN ls = 'O' THEN 'isolated' ELSE 'embedding' END AS class_name
FROM (SELECT l_orderkey AS image_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep, l_quantity AS q, l_discount AS d, l_tax AS t, l_linestatus AS ls FROM {lineitem}) s
"""
POINTS = """
SELECT image_id * 100 + box_id AS poly_id, ord, CASE ord WHEN 1 THEN x WHEN 2 THEN x + w WHEN 3 THEN x + w + 5 WHEN 4 THEN x + w ELSE x END AS x,
       CASE ord WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN y + h / 2 WHEN 4 THEN y + h ELSE y + h END AS y
FROM (SELECT * FROM {v_boxes} b CROSS JOIN (SELECT 1 AS ord UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) o) p
"""
ANCHORS = """
SELECT image_id, box_id AS anchor, x + w / 2 AS cx, y + h / 2 AS cy, w, h, 10 * (confidence - 0.9) AS c0, CASE WHEN class_id = 1 THEN 0.5 ELSE -0.5 END + 5 * (confidence - 0.95) AS c1 FROM {v_boxes} b
"""
LOGITS = """
SELECT vec_id AS seq_id, t, v, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, CAST(floor((i - 1) / 8) AS BIGINT) AS t, (i - 1) % 8 AS v, x FROM {flat} f) s
"""
GRAY = """
SELECT vec_id AS image_id, CAST(floor((i - 1) / 4) AS BIGINT) AS r, (i - 1) % 4 AS c, CAST(floor(abs(x) * {thousand}) AS BIGINT) % 256 AS gray FROM {flat} f
"""
FORMULAS = r"""
SELECT p_partkey AS formula_id, CASE p_partkey % 16
  WHEN 0 THEN concat('\frac{', p_size, '}{', p_partkey, '}') WHEN 1 THEN concat('x^{', p_size, '} + \alpha_{', p_partkey, '}')
  WHEN 2 THEN concat('a == ', p_size) WHEN 3 THEN concat('\sqrt{', p_size, ' + {b') WHEN 4 THEN concat('\left( x + ', p_size)
  WHEN 5 THEN concat('\begin{matrix} 1 & ', p_size, ' \\ 3 & 4 \end{matrix}') WHEN 6 THEN concat('\begin{cases} x \end{matrix} ', p_size)
  WHEN 7 THEN '\pi \pi \pi \pi \pi \pi \pi \pi \pi' WHEN 8 THEN concat('a & b & ', p_size) WHEN 9 THEN concat('\{ y \} \leq ', p_size)
  WHEN 10 THEN concat('\sum_{i=0}^{', p_size, '} i^2') WHEN 11 THEN concat('  \sin ', p_size, ' \to \infty  ') WHEN 12 THEN concat('$x + ', p_size, '$')
  WHEN 13 THEN concat('\mathbf{v} \cdot \hat{', 'w} = ', p_size) WHEN 14 THEN concat('q \== ', p_size, ' } ') ELSE concat('\text{size } ', p_size, ' \times \beta') END AS latex
FROM {part}
"""
MIXED = """
SELECT item_id * 10 + k AS id, concat(s, ' ', text) AS text FROM {benchmark} b CROSS JOIN (
  SELECT 0 AS k, 'ab中文cd' AS s UNION ALL SELECT 1, 'end.Next,word' UNION ALL SELECT 2, '你好,world(x)再见' UNION ALL SELECT 3, 'f(x)=y;中' UNION ALL SELECT 4, 'plain text' UNION ALL SELECT 5, '漢字漢字') m
"""
BLOCKS = """
SELECT doc_id, CAST(0 AS INTEGER) AS page_idx, CAST(k AS INTEGER) AS ord, CASE k % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'formula' WHEN 3 THEN 'list' WHEN 4 THEN 'quote' WHEN 5 THEN 'code' WHEN 6 THEN 'table' WHEN 7 THEN 'figure' ELSE 'horizontal_rule' END AS kind,
       CAST(1 + k % 6 AS INTEGER) AS level, CASE k % 9 WHEN 3 THEN replace(line, '. ', concat('.', chr(10))) WHEN 4 THEN replace(line, ', ', chr(10)) WHEN 6 THEN replace(replace(line, ', ', chr(10)), ' ', chr(9)) ELSE line END AS text,
       CASE WHEN k % 18 = 5 THEN 'sql' END AS language, k % 2 = 1 AS ordered FROM {lines} l
"""
NODES = """
SELECT * FROM (SELECT 'linear' AS pipeline, 'load' AS name, '' AS dep UNION ALL SELECT 'linear', 'scan', 'load' UNION ALL SELECT 'linear', 'emit', 'scan'
  UNION ALL SELECT 'diamond', 'a', '' UNION ALL SELECT 'diamond', 'b', 'a' UNION ALL SELECT 'diamond', 'c', 'a' UNION ALL SELECT 'diamond', 'd', 'b' UNION ALL SELECT 'diamond', 'd', 'c'
  UNION ALL SELECT 'broken', 'x', 'nowhere' UNION ALL SELECT 'loop', 'p', 'q' UNION ALL SELECT 'loop', 'q', 'p') n
"""
JOBS = """
SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, event_id FROM {events}
"""
_VIEWS = {"v_boxes": BOXES, "v_points": POINTS, "v_anchors": ANCHORS, "v_logits": LOGITS, "v_gray": GRAY, "v_formulas": FORMULAS, "v_mixed": MIXED, "v_blocks": BLOCKS, "v_nodes": NODES, "v_jobs": JOBS}
#: Flattened arrays, lines and a 32-bit factor, the things that both engines write differently: DuckDB multiplies a float
#: and an integer in 32 bits, Spark in 64, which may fall on the other side of a whole number.
_SPARK = {
    "thousand": "CAST(1000 AS FLOAT)",
    "flat": "(SELECT vec_id, pos + 1 AS i, x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x)",
    "lines": "(SELECT doc_id, pos AS k, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line)",
}
_DUCK = {
    "thousand": "1000",
    "flat": "(SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings)",
    "lines": "(SELECT doc_id, unnest(range(len(s))) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))",
}


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL that may name given tables and the views above in braces."""
    held = spark.conf.get("spark.sql.parser.escapedStringLiterals")
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")  # backslashes are plain, as in standard SQL
    try:
        return spark.sql(_filled(text, _SPARK, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
    finally:
        spark.conf.set("spark.sql.parser.escapedStringLiterals", held)


def duck_sql(text: str) -> str:
    """The same for DuckDB."""
    return _filled(text, _DUCK, lambda t: t)


def _filled(text: str, own: dict[str, str], table) -> str:
    """Braces of LaTeX in the formula view are no names: only known names are filled in."""
    known = set(_VIEWS) | set(own) | {"lineitem", "part", "benchmark", "events", "documents", "embeddings", "orders", "pages", "conversations"}

    def put(m: re.Match) -> str:
        if m[1] not in known:
            return m[0]
        if m[1] in _VIEWS:
            return "(" + _filled(_VIEWS[m[1]], own, table) + ")"
        return _filled(own[m[1]], own, table) if m[1] in own else table(m[1])

    return re.sub(r"\{([a-z_]+)\}", put, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "SELECT * FROM {" + name + "} s")
