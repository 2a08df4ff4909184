import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.llm import op8_sharding as op


def check(rows, result, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in result if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(result) == len(rows)
    counts = Counter(r.shard for r in result)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(0 <= r.shard < shards for r in result)
    slots = defaultdict(list)
    for r in result:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r.law, r.grown_shard) for r in result} <= {("rows", None)}


def corpus(seed, n, hot):
    rng = random.Random(seed)
    texts = ["hot"] * hot + [None, "", None] + ["pair %d" % (i // 3) for i in range(60)] + ["single %d é" % i for i in range(n)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "hot", "shards"), [(300, 150, 40), (500, 20, 7), (0, 0, 40)])
def test_law_and_groups(spark, n, hot, shards):
    rows = corpus(1, n, hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("row", F.lit(1))
    result = op.shard_documents(df.repartition(3), shards).collect()
    check(rows, result, shards)
    where = defaultdict(Counter)
    texts = dict(rows)
    for r in result:
        where[texts[r.doc_id] or ""][r.shard] += 1
    capacity = -(-len(rows) // shards)
    if n:
        apart = sum(sum(c.values()) - max(c.values()) for t, c in where.items() if sum(c.values()) <= capacity)
        dealt = sum(sum(c.values()) - 1 for t, c in where.items() if sum(c.values()) <= capacity)
        assert apart <= 0.15 * dealt, (apart, dealt)


def test_everything_linked_swaps(spark):
    rows = [(i, "t%d" % (i % 20)) for i in range(200)]
    result = op.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    check(rows, result, 10)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, op.shard_documents(df, 3).collect(), 3)
    assert op.shard_documents(df.limit(0)).count() == 0


def test_many_rounds_end_at_a_fixed_point(spark):
    rows = [(i, "t%d" % (i % 3)) for i in range(240)]
    out = op.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    check(rows, out, 12)
