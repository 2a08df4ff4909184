import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import op10_simhash as op
from folioframe.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(1), op.covering_masks()
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    for _ in range(20000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(d & m == 0 for m in masks)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('añ b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest("añ b c d".encode(), 42)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "İx", "ABC"]
    texts = [None, "", " \n\t", "one", "One", "a b c", "a b c d"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\n".join(other) if rng.random() < 0.2 else " ".join(other))
    texts += [texts[9]] * 40 + ["x " * 50000]
    rows = [(1000 - i if i % 3 else i, t) for i, t in enumerate(texts)] + [(5, texts[9]), (5, texts[9]), (None, texts[10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("least", F.lit(1))
    prints = {t: brute_print(t) for _, t in rows}
    assert all(op.simhash(t) == fp for t, fp in prints.items())
    kinds = sorted(set(prints.values()))
    group = closure(kinds, [(a, b) for a, b in itertools.combinations(kinds, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[prints[t]]] = min(i, least.get(group[prints[t]], i))
    want = sorted(((i, "%016x" % prints[t], least[group[prints[t]]]) for i, t in rows), key=str)
    got = op.near_duplicates(df).select("doc_id", op.hexadecimal(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_in_blocks(spark):
    rng = random.Random(3)
    kinds = {0, (1 << 64) - 1}
    while len(kinds) < 300:
        kinds.add(rng.choice(sorted(kinds)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    kinds = sorted(kinds)
    df = spark.createDataFrame([(op._signed(x),) for x in kinds], "fp long")
    want = closure(kinds, [(a, b) for a, b in itertools.combinations(kinds, 2) if (a ^ b).bit_count() <= 4])
    for block in (4096, 7):
        found = [(a % 2**64, b % 2**64) for a, b in op.links(df, block=block).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        assert closure(kinds, found) == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = closure({x for p in real for x in p}, real)
    assert got.keys() == want.keys()
    assert len(set(zip(got.values(), (want[x] for x in got), strict=True))) == len(set(want.values())) == len(set(got.values()))
    assert np.all([want[got[x]] == want[x] for x in got])
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_keep_one_keeps_a_column_that_is_called_as_its_own(spark):
    df = spark.createDataFrame([(1, "a b c d e", 70), (2, "a b c d e", 80), (2, "z y x w v", 90)], "doc_id long, text string, folioframe_number int")
    kept = op.keep_one(df)
    assert kept.columns == df.columns and {r.folioframe_number for r in kept.collect()} <= {70, 80, 90}
