"""The corpus pipeline: classify, drop near-duplicates, cut repeated strings, redact secrets, pack.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents;
n_chars follows the text.

- quality: rows that the classifier rejects go.
- near_duplicates: of each group of linked fingerprints the row of the smallest doc_id stays (of repeated ids, the one
  whose text has the least hash; null ids come last).
- suffix_dedup: strings of 100 bytes or more that occur earlier are cut out of the texts.
- secrets: each secret is replaced by a mask.
- packing: the last stage's rows are pieces of documents.

Null texts count as empty everywhere and stay null; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import op1_suffix_dedup, op5_packing, op7_quality_classifier, op9_secrets, op10_simhash
from folioframe.llm.op6_bpe import vocabulary
from folioframe.llm.storage import fresh_path

#: SQL has neither language models nor fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the texts now are."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is within their language's threshold."""
    model = op7_quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op7_quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return op10_simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier."""
    return _counted(op1_suffix_dedup.deduplicate(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _counted(op9_secrets.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, without padding."""
    return op5_packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
