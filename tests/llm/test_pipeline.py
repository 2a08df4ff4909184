import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from folioframe.llm import op1_suffix_dedup, op9_secrets, op10_simhash
from tests.llm.test_simhash import brute_print, closure
from tests.llm.test_suffix_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result over sf0.001 with some awkward rows added."""
    sf = tmp_path_factory.mktemp("sf")
    given = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{given}/documents.parquet").where("doc_id < 70")
    text = docs.where("doc_id = 4").first().text
    more = [(70, text, "fr", "s", 1), (71, None, "en", "s", 0), (72, "", None, None, None), (73, "Is and the of token = 'abcd1234efgh5678' by for and the, " + text, "fr", "s", 3), (4, text, "fr", "s", 4)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("kept", F.lit("clash"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{given}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    out, now = [], spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(sf)).write.parquet(f"{sf}/out{i}")
        result = spark.read.parquet(f"{sf}/out{i}")
        out.append((now, result))
        now = result
    return out


def test_columns_stay(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "secret scans", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_quality_keeps_clean_rows(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    joined = labels.join(before.select("doc_id").distinct(), "doc_id")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert all(r.doc_id in kept for r in joined.where("quality = 1").collect())
    assert sum(r.doc_id in kept for r in joined.where("quality = 0").collect()) <= 1


def test_near_duplicates_against_brute_force(stages):
    before, after = (x.collect() for x in stages[1])
    prints = [brute_print(r.text) for r in before]
    kinds = sorted(set(prints))
    group = closure(kinds, [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (a ^ b).bit_count() <= op10_simhash.RADIUS])
    first = {}
    for r, p in zip(before, prints, strict=True):
        first[group[p]] = min(r.doc_id, first.get(group[p], r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(first.values())


def test_suffix_dedup_against_brute_force(stages):
    before, after = stages[2]
    want = {i: n - removed for i, n, removed, *_ in brute(sorted((r.doc_id, r.text) for r in before.collect()))}
    got = {r.doc_id: r for r in after.collect()}
    assert got.keys() == want.keys()
    for i, n in want.items():
        assert n - 8 <= len((got[i].text or "").encode()) <= n
        assert got[i].text is None or got[i].n_chars == len(got[i].text)


def test_secrets_are_masked(stages):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[3])
    own = op9_secrets.scanner()
    for i, text in before.items():
        spans = own.scan(text or "")
        assert (after[i] == text) == (not spans)
        assert own.scan(after[i] or "") == []


def test_packing_covers_everything(stages):
    before, after = stages[4]
    pieces = {}
    for p in after.collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert sorted(pieces) == sorted(r.doc_id for r in before.collect())
    for x in pieces.values():
        assert sum(p.length for p in x) == x[0].doc_tokens == sum(len(p.ids) for p in x)


def test_one_of_repeated_ids(spark):
    rng = random.Random(1)
    long = " ".join("w%d" % rng.randrange(50) for _ in range(200))
    rows = [(1, long, "a"), (1, long, "b"), (None, long, "c"), (1, "other text of a few words here", "d"), (2, None, "e"), (3, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = op10_simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.source for r in kept.collect()) in (["a", "d", "e"], ["b", "d", "e"])
    assert op10_simhash.keep_one(df.limit(0)).count() == 0 and op1_suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_run_over_whole_and_empty_tables(spark, stages, tmp_path):
    given = "/root/testdata/sf0.001"
    first = stages[0][0]
    first.write.parquet(f"{tmp_path}/a/documents.parquet")
    first.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for sf in ("a", "b"):
        spark.read.parquet(f"{given}/labels.parquet").write.parquet(f"{tmp_path}/{sf}/labels.parquet")
    whole = cp.run(spark, f"{tmp_path}/a")
    last = stages[-1][1]
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert whole.columns == last.columns
    assert sorted(map(str, whole.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(str, last.select("doc_id", "doc_tokens").distinct().collect()))
    assert sorted(map(str, whole.select([c for c in key if c in whole.columns]).collect())) == sorted(map(str, last.select([c for c in key if c in last.columns]).collect()))
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
