"""Quality rules in DataFrame functions alone: base rules, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials are counted over whole texts: of all
documents (raw), and of a bounded sample of those that labels trust, quality 1 and toxic 0 (target): MAX_TRUSTED rows,
the least by a hash of doc_id. A bucket weighs
log((target + PRIOR) / (expected + PRIOR)), where expected is what the raw multinomial puts there for as many n-grams;
the prior keeps rare buckets from saying much. A document's score is the mean weight of its n-grams, and documents
that pass the base rules are kept if it is at least THRESHOLD, a constant. The weights are the only thing broadcast: at
most BUCKETS rows, beside the ids of the sample.

Null and empty texts have no words and fail the base rules. Repeated rows each give a row. Labels that are repeated
count with their worst values, null labels trust nothing; with nothing trusted every weight is 0. An empty table gives
an empty result. Other columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.storage import write_table
from folioframe.llm.trusted import trusted_ids

BUCKETS = 1 << 16
MAX_TRUSTED = 50_000
PRIOR = 5.0
THRESHOLD = -0.12
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, words, more) with the words of every text; null: none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    bare = F.btrim("text", F.lit(_BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK + "+"))
    return named.withColumn("words", words)


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds h1 and h2: hashes of each word and of each pair of neighbours, in order."""
    one = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return one.withColumn("h2", _joined("h1", 1))


def _joined(column: str, step: int) -> Column:
    """Hashes of each element with the one step further on, for all that have one."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.transform(F.slice(F.col(column), F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(F.col(column), i + step)))


def _buckets() -> Column:
    return F.transform(F.concat("h1", "h2"), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def weights(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """(bucket, weight) of every bucket that occurs."""
    trusted = trusted_ids(labels, most).select(F.col("doc_id").alias("trusted"))
    rows = with_words(docs)
    marked = rows.join(F.broadcast(trusted), rows.doc_id == F.col("trusted"), "left")
    each = with_hashes(marked).select("trusted", F.explode(_buckets()).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    expected = F.col("raw") * F.col("targets") / F.col("raws")
    counts, _ = write_table(counts, "buckets")
    totals = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    joined = counts.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")
    return joined.select("bucket", F.log((F.col("target") + PRIOR) / (expected + PRIOR)).alias("weight"))


def base_columns(df: DataFrame) -> DataFrame:
    """doc_id, the base counts and base_failed, beside h1 and h2."""
    four = df.withColumn("h4", _joined("h2", 2))
    eight = four.withColumn("h8", _joined("h4", 4))
    placed = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    sorted_ = eight.withColumn("s", F.when(some, placed))
    again = lambda x, j: (F.get("s", j + 1).getField("h") == x.h) | ((j > 0) & (F.get("s", j - 1).getField("h") == x.h))
    twice = sorted_.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, j: F.coalesce(again(x, j), F.lit(False))), lambda x: x.i)))
    covered = F.transform("p", lambda x, j: F.coalesce(F.least(F.get("p", j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    lines = twice.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = lines.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        "h1",
        "h2",
    )
    return counted.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The base columns, base_failed, kept, score (null without words) of every row of docs (doc_id, text)."""
    rows = base_columns(with_hashes(with_words(docs))).withColumn("row", F.monotonically_increasing_id())
    own = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    each = rows.select(*own, F.explode_outer(_buckets()).alias("bucket"))
    weighed = each.join(F.broadcast(weights(docs, labels)), "bucket", "left")
    scored = weighed.groupBy(*own).agg((F.sum("weight") / F.count("bucket")).alias("score"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return scored.select(*own[1:], kept.alias("kept"), "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base counts, base verdict, and the verdict of the likelihood ratio."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
