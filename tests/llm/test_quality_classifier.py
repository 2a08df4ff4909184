import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import op7_quality_classifier as op

WORDS = ["aba", "cab", "Dada", "eel,", "fig.", "go", "ha", "it", "ja", "ka"]


def corpus(rng, n, junk=False):
    return [" ".join((rng.choice(WORDS[:6]) if rng.random() < 0.7 else rng.choice(WORDS)) + ("***" if junk else "") for _ in range(rng.randint(5, 60))) for _ in range(n)]


def brute(texts, train):
    """Interpolated modified Kneser-Ney over plain dictionaries."""
    seen = Counter(w for t in train for w in t.split())

    def toks(t):
        out, before = ["<s>", "<s>"], None
        for w in t.split():
            out.append("<again>" if w == before else w if seen[w] >= op.MIN_COUNT else op.letter_class(w))
            before = w
        return [*out, "</s>"]

    counts = {3: Counter(), 2: Counter(), 1: Counter()}
    for t in train:
        x = toks(t)
        counts[3].update(tuple(x[i - 2 : i + 1]) for i in range(2, len(x)) if x[i] != "<again>")
    for n in (2, 1):
        counts[n].update(g[1:] for g in counts[n + 1])
    d, sums = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        if k[1] and k[2]:
            y = k[1] / (k[1] + 2 * k[2])
            d[n] = [min(max(j - (j + 1) * y * k[j + 1] / k[j] if k[j] else 0.5, 0.05), j) for j in (1, 2, 3)]
        else:
            d[n] = [0.5] * 3
        sums[n] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            sums[n][g[:-1]][0] += v
            sums[n][g[:-1]][1] += d[n][min(v, 3) - 1]
    total, freed = sums[1][()]
    base = freed / total / (len(counts[1]) + 1)

    def p(g):
        if not g:
            return base / (freed / total)
        n = len(g)
        if g[:-1] not in sums[n]:
            return p(g[1:])
        t, f = sums[n][g[:-1]]
        v = counts[n].get(g, 0)
        return (v - d[n][min(v, 3) - 1] if v else 0) / t + f / t * p(g[1:])

    out = []
    for t in texts:
        x = toks(t)
        out.append(-sum(math.log(base if x[i] == "<again>" else p(tuple(x[i - 2 : i + 1]))) for i in range(2, len(x))) / (len(x) - 2))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    good, bad = corpus(rng, 150), corpus(rng, 40, junk=True)
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", "xx"), (5, good[5], "en"), (None, good[6], "en"), (902, "go go go go go go go go go go go go go go go go", "en")]
    labels = [(i, 1 if i < 150 else 0, 0) for i in range(0, 190, 2)] + [(1, 1, 1), (3, None, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (5000, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash")).withColumn("h", F.lit(1))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_scores_equal_plain_dictionaries(spark, tables):
    docs, labels, rows = tables
    model = op.train(docs, labels)
    texts = {i: t for i, t, _ in rows if i is not None}
    ids = spark.createDataFrame([(i,) for i in range(0, 150, 2)], "i long")
    held = {r.i for r in ids.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(op.HELD_OUT)) == 0).collect()}
    train = [texts[i] for i in range(0, 150, 2) if i not in held]
    every = [t or "" for _, t, _ in rows]
    sizes, got = model.scores([t for _, t, _ in rows])
    assert np.allclose(got, brute(every, train), rtol=1e-4)
    assert sizes.tolist() == [len(t.split()) + 1 for t in every]
    result = op.classify(docs, model).collect()
    assert len(result) == len(rows)
    verdict = {r.doc_id: r.kept for r in result}
    assert all(verdict[i] for i in range(150)) and not any(verdict[i] for i in range(150, 190)) and not verdict[902]
    kept = op.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in result)
    assert op.classify(docs.limit(0), model).count() == 0


def test_sample_is_bounded(tables):
    docs, labels, _ = tables
    assert 0 < op.trusted_ids(labels, 10).count() <= 10
    small = op.train(docs, labels, max_words=300)
    assert 0 < sum(len(op._unpacked_counts(r.data)[0]) for r in small.trigrams.collect()) <= 300


def test_nothing_trusted(spark, tables):
    docs, labels, rows = tables
    assert op.train(docs, labels.where("false")) is None
    assert op.classify(docs, None).where("kept").count() == len(rows) == op.keep_good(docs, None).count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    wrong = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert wrong.get((0, True), 0) <= 2 and wrong.get((1, False), 0) <= 2


def test_every_trusted_row_is_learnt_and_joins_equal_plain_dictionaries(spark, tables):
    docs, labels, rows = tables
    own, last = op.train(docs, labels), "zu ka " * 700_000  # alone more words than the cap that there was
    ids = spark.createDataFrame([(i,) for i in range(2000, 2020)], "i long")
    at = ids.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(op.HELD_OUT)) != 0).orderBy(F.xxhash64("i", F.lit(7)).desc()).first().i
    more = docs.unionByName(spark.createDataFrame([(at, last, "en")], "doc_id long, text string, lang string").withColumn("kept", F.lit("")).withColumn("h", F.lit(1)))
    model = op.train(more, labels.union(spark.createDataFrame([(at, 1, 0)], labels.schema)))
    assert "zu" in model.vocabulary and "zu" not in own.vocabulary
    got = {r.doc_id: (r.n_words, r.log_perplexity) for r in op.classify(docs, own).where("doc_id is not null").collect()}
    sizes, want = own.scores([t for _, t, _ in rows])
    for (i, _, _), n, x in zip(rows, sizes.tolist(), want, strict=True):
        assert i is None or (got[i][0] == n and abs(got[i][1] - x) < 1e-4)


def test_one_long_row_does_not_end_training(spark, tables):
    docs, labels, _ = tables
    trusted = docs.join(op.trusted_ids(labels, None).select("doc_id", F.col("h").alias("hash")), "doc_id").orderBy("hash")
    first = trusted.first().doc_id
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("zu ka "), 500)).otherwise(F.col("text")))
    model = op.train(longer, labels, max_words=600)
    assert model is not None and "aba" in model.vocabulary and "zu" not in model.vocabulary
    assert op.train(docs, labels, max_words=1) is not None


def test_thresholds_are_of_all_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=4)), "xx" if i % 100 == 0 else "en") for i in range(15_000)]  # 1 % of 5,000 would be too few
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(op.HELD_OUT)) == 0
    texts = [r.text for r in docs.where("lang = 'xx'").where(held).collect()]
    assert len(texts) >= op.MIN_HELD
    model = op.train(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert set(model.thresholds) == {"xx", "en"}
    assert abs(model.thresholds["xx"] - np.quantile(model.scores(texts)[1], op.QUANTILE) - op.MARGIN) < 1e-3
    one = docs.where(~held).limit(1)
    assert op.train(one, one.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).overall is not None


def test_passes_and_shards_change_nothing(spark, tables, monkeypatch):
    docs, labels, _ = tables
    want = {(r.doc_id, r.lang, r.n_words, round(r.log_perplexity, 9)) for r in op.classify(docs, op.train(docs, labels)).collect()}
    monkeypatch.setattr(op, "PASSES", 3)
    monkeypatch.setattr(op, "SHARD_WORDS", 20)
    monkeypatch.setattr(op, "BLOCK", 100)
    model = op.train(docs, labels)
    assert model.sharding.shards > op.LEAST_SHARDS and model.sharding.salts.max() > 3
    assert {(r.doc_id, r.lang, r.n_words, round(r.log_perplexity, 9)) for r in op.classify(docs, model).collect()} == want
