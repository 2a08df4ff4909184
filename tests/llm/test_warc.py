import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioframe.llm import op3_warc as op
from folioframe.llm.ordering import NUMBER, numbered
from folioframe.llm.storage import fresh_path


def brute(rows):
    """rows (page_id, url, html): with unique ids."""
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = last[h or ""] != i
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None


def pages(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = rng.choice([None, "", "no host", "http://h.example.com/%d" % (i % 7), "https://u:p@WWW.Example.org:80/a b\n?q=%d#x" % i, "http://hot.example.net/same", "//é.fr/ü"])
        rows.append((i * 3 - 5, url, rng.choice([None, "", "<p>same</p>", "\r\n\r\n", "x%d é" % i, "y" * rng.randrange(5000)])))
    rng.shuffle(rows)
    return rows


def taken(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_against_brute_force(spark, monkeypatch):
    rows = pages(400) + [(10**12, "http://big", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("number", F.lit(1))
    got = op.round_trip(df.repartition(3))
    assert taken(got) == sorted(brute(rows), key=str)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (None, None, None), (5, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op.round_trip(df).collect()
    assert len(got) == 6 and sum(r.record_type == "response" for r in got) == 2
    assert op.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 300])
def test_index_finds_every_capture_and_nothing_else(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rows = [(i, "http://%s.example.com/%d" % ("abc"[i % 3], i // 2), "t%d" % i) for i in range(40)]
    df = numbered(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "html")[0]
    archive = fresh_path(spark, "test")
    directory = op.write(df, archive)
    starts = sorted((min(r["first"] for r in directory.collect() if r.part == p), p) for p in {r.part for r in directory.collect()})
    reader = op.Reader(archive, starts)
    keys = df.select(op.reversed_host_key("url").alias("k"), NUMBER, "page_id", "html").collect()
    for r in keys:
        found = reader.find(op._key(r.k, r[NUMBER]))
        assert found["page_id"] == r.page_id and found["payload"] == r.html.encode()
        assert reader.find(op._key(r.k, r[NUMBER] + 1000)) is None
    assert reader.find("") is None and reader.find("zzz") is None
    assert sum(r.lines for r in directory.collect()) == 40


def test_keys(spark):
    urls = ["http://www.Example.com/a?b#c", "https://u:p@h.org:8080", "", None, "x y", "//a.b/c"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "url string").select(op.reversed_host_key("url").alias("k")).collect()]
    assert got == ["com,example,www)/a?b", "org,h)", ")", ")", ")x+y", "b,a)/c"]


def test_query_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet' UNION ALL SELECT 10000 + page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet' WHERE page_id % 3 = 0")
    rows = c.sql("SELECT page_id, url, html FROM pages").fetchall()
    want = sorted(c.sql("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + op.ORACLE_SQL + ") q").fetchall(), key=str)
    assert taken(op.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))) == want


@pytest.mark.parametrize("block", [1, 300])
def test_other_line_ends_in_urls(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rows = [(i, "http://h%d.example.com/a%sb %d" % (i % 3, "\u0085\u2028\u2029\x1c\n\u00a0x"[i % 7], i), "t%d" % i) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert taken(op.round_trip(df)) == sorted(brute(rows), key=str)


def test_a_missing_capture_is_an_error(spark):
    df = numbered(spark.createDataFrame([(1, "http://a.b/c", "x"), (2, "http://a.b/d", "y")], "page_id long, url string, html string"), "page_id", "html")[0]
    archive = fresh_path(spark, "test")
    directory = op.write(df.where("page_id = 1"), archive)
    assert op.lookup(df, archive, directory).count() == 1
    with pytest.raises(Exception, match="lacks the capture"):
        op.lookup(df, archive, directory, whole=True).collect()
