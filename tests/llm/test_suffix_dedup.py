import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import op1_suffix_dedup as op


def brute(rows):
    """rows in document order -> removals, by a dictionary of all strings of LENGTH bytes."""
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        cover = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - op.LENGTH + 1):
            w = data[s : s + op.LENGTH]
            if w in seen:
                cover[s : s + op.LENGTH] = True
            seen.add(w)
        kept = bytes(b for b, c in zip(data, cover, strict=False) if not c)
        runs = int((np.diff(cover.astype(int)) == 1).sum() + cover[0])
        out.append((i, len(data), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(20, 60)) for _ in range(5)]
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "y" * 3000]
    for _ in range(n):
        parts = [text(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared)[rng.randrange(30) :])
        texts.append(" ".join(parts))
        if rng.random() < 0.4:
            near = texts[-1].split(" ")
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    return texts + [texts[-1]] * 4 + [texts[-2]]


def taken(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ways", [4, 2])
def test_against_brute_force(spark, monkeypatch, ways):
    monkeypatch.setattr(op, "WAYS", ways)
    rows = [(i * 3 - 50, t) for i, t in enumerate(corpus(2048 * ways))]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("spans", F.lit(2))
    assert taken(op.removals(df.repartition(4))) == sorted(brute(sorted(rows)), key=str)


def test_repeated_and_null_ids(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (None, "q" * 150), (None, None), (2, "r" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert taken(op.removals(df)) == sorted(brute([(1, "q" * 150), (1, "q" * 150), (2, "r" * 100), (None, "q" * 150), (None, None)]), key=str)
    assert op.removals(df.limit(0)).count() == 0


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(6)
    data = bytes(rng.choice(b"abc ") for _ in range(5000))
    whole = op.anchors(data)
    monkeypatch.setattr(op, "CHUNK", 700)
    parts = op.anchors(data)
    assert parts[2].sum() == whole[2].sum() == len(data) - op.LENGTH + 1
    place = lambda x: {int(f) + j: int(f + o) for f, n, o in zip(*x[1:4], strict=True) for j in range(int(n))}
    assert place(parts) == place(whole)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    inner = bytes(rng.choice(b"abc") for _ in range(100))
    offsets = set()
    for _ in range(50):
        left = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        k, first, n, offset = op.anchors(left + inner + b"zz" * rng.randint(0, 50))[:4]
        i = int(np.searchsorted(first, len(left), "right")) - 1
        offsets.add((int(k[i]), int(first[i] + offset[i]) - len(left)))
    assert len(offsets) == 1


def test_text_column(spark):
    rows = [(1, "é" * 80 + "tail", "a"), (2, "x" + "é" * 80 + "end", "b"), (3, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = {r.doc_id: r for r in op.deduplicate(df).collect()}
    assert op.deduplicate(df).columns == df.columns and out[3].text is None and out[2].other == "b"
    assert out[2].text == "xend"


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "q" * 150, 7, "a"), (2, "q" * 150, 8, "b")], "doc_id long, text string, folioframe_number int, Folioframe_Spans string")
    out = sorted(map(tuple, op.deduplicate(df).collect()))
    assert out == [(1, "q", 7, "a"), (2, "", 8, "b")]
    assert op.deduplicate(df).columns == df.columns
