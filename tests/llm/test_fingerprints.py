import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import op4_fingerprints as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*longs, width=8):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x % (1 << 8 * width)).to_bytes(width, "little"), seed)
    return seed


def brute(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    if len(words) >= 5:
        two = [chain(a, b) for a, b in zip(words, words[1:])]
        four = [chain(a, b) for a, b in zip(two, two[2:])]
        grams = [chain(a, b) for a, b in zip(four, words[4:])]
    else:
        grams = [chain(*words)]
    bins = {}
    for g in map(signed, grams):
        b = (g >> 56) + 128
        bins[b] = min(g, bins.get(b, g))
    out = []
    for b in range(256):
        if b not in bins:
            donor = next((d for a, c in op._constants() if (d := (b * a + c) % op._PRIME % 256) in bins), None)
            donor = donor if donor is not None else min(bins, key=lambda j: (signed(chain(b, j, width=4)), j))
        else:
            donor = b
        out.append(bins[donor] & 255)
    return bytes(out).hex()


def alike(a, b):
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2)) / 256
    return max(0.0, (same - 2**-8) / (1 - 2**-8))


def expected(rows):
    """rows in descending doc_id, nulls last."""
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        prints = brute(t), brute(edited)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(alike(*prints), 9), round(alike(prints[0], brute(after)), 9)


def taken(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n", "one", "a b c d", "a b c d e", "é😀ß " * 7, "z" * 200000, "w " * 30000]
    for _ in range(60):
        out.append(" ".join("w%d" % rng.randrange(400) for _ in range(rng.randint(1, 900))))
    return out


def test_against_brute_force(spark):
    rows = [(3 * i - 40, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit("clash")).withColumn("r", F.lit(1)).withColumn("guest", F.lit(1))
    ordered = sorted(rows, key=lambda x: -x[0])
    assert taken(op.fingerprint_edits(df.repartition(3))) == sorted(expected(ordered), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows_and_null_ids(spark, n):
    rows = [(5, "a b c d e f g"), (None, "q r s t u"), (None, "q r s t u")][:n]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert taken(op.fingerprint_edits(df)) == sorted(expected(rows), key=str)


def test_repeated_ids(spark):
    rows = [(i % 4, "x y z %d" % (i % 3)) for i in range(40)]
    assert op.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40


def test_likeness_is_near_the_truth(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(40):
        a = ["u%d" % rng.randrange(10**6) for _ in range(rng.randint(30, 1500))]
        b = a[: int(len(a) * rng.random())] + ["v%d" % rng.randrange(10**6) for _ in range(50)]
        rows += [(2 * i + 1, " ".join(a)), (2 * i, " ".join(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        truth[2 * i + 1] = len(x & y) / len(x | y)
    found = {r.doc_id: r.near_next for r in op.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = [abs(found[i] - j) for i, j in truth.items()]
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.15


def test_ranges_are_found_by_binary_search(spark):
    ids = [None, -(10**15), 0, 5, 10**15, *range(-3, 60)]
    df = spark.createDataFrame([(x,) for x in ids], "doc_id long")
    for cuts in ([], [5], [0, 5], [-1, 0, 7, 8, 9, 30, 31], list(range(-2, 58, 2))):
        for r in df.select("doc_id", op._place(F.col("doc_id"), cuts).alias("range")).collect():
            assert r.range == (len(cuts) + 1 if r.doc_id is None else sum(c >= r.doc_id for c in cuts))
