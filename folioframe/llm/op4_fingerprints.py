"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit codes, in DataFrame functions.

Every shingle of SHINGLE words is hashed once. The hash's high bits are its bin, and each bin keeps its least hash. An
empty bin copies the bin that a universal hash of its number and the attempt names, at the first attempt that names a
filled one; what ATTEMPTS leave empty takes the filled bin that comes first in its own pseudo-random order. The low
CODE_BITS of each bin's hash are packed. Two fingerprints agree in a share f of the bins; chance agreement is
c = 2^-CODE_BITS, so their likeness is (f - c) / (1 - c), at least 0.

The neighbour in descending doc_id is found without a global sort: rows are dealt to ranges of doc_id whose limits are
approximate quantiles, each range's first row is dealt to the range before as well, and each range is a window. Texts
are shuffled once.

Null texts count as empty. A text without words has a fixed fingerprint of its own, one of fewer than SHINGLE words has
them all as its shingle. Null ids come last; rows of equal id are in the order of their texts' hashes. Repeated rows each
give a row; a single row is its own neighbour; an empty table gives an empty result. Other columns have no effect.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.op2_quality_rules import _joined, with_words

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
CODE_BITS = 8
ATTEMPTS = 16
RANGES_A_PARTITION = 4
#: A range has about as many bytes of text at most, however few shuffle partitions there are.
RANGE_BYTES = 1 << 26
_PRIME = (1 << 31) - 1
_HEX = "".join("%02x" % x for x in range(256))


def _constants(seed: int = 17) -> list[tuple[int, int]]:
    """Multiplier and offset of the universal hash of each attempt."""
    rng = random.Random(seed)
    return [(rng.randrange(1, _PRIME), rng.randrange(_PRIME)) for _ in range(ATTEMPTS)]


def _named(bin_: Column, attempt: int) -> Column:
    a, c = _constants()[attempt]
    return F.pmod(F.pmod(bin_.cast("long") * F.lit(a) + F.lit(c), F.lit(_PRIME)), F.lit(BINS)).cast("int")


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + F.lit(BINS // 2)


def with_codes(df: DataFrame, out: str) -> DataFrame:
    """Adds the fingerprint of the words as an array of BINS bytes (each the code less 128), and drops the words."""
    kept = [c for c in df.columns if c != "words"]
    one = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    two = one.withColumn("h2", _joined("h1", 1))
    four = two.withColumn("h4", _joined("h2", 2))
    last = F.greatest(F.size("h1") - (SHINGLE - 1), F.lit(0))
    grams = F.transform(F.slice("h4", F.lit(1), last), lambda x, i: F.xxhash64(x, F.get(F.col("h1"), i + SHINGLE - 1)))
    five = four.withColumn("g", F.sort_array(F.when(F.size("h1") >= SHINGLE, grams).otherwise(F.array(F.xxhash64("h1")))))
    least = five.withColumn("m", F.filter("g", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col("g"), i - 1)))))
    filled = least.withColumn("at", F.transform("m", lambda h: _bin(h).cast("int")))
    code = lambda h: (h.bitwiseAND(F.lit((1 << CODE_BITS) - 1)) - 128).cast("tinyint")
    gap = lambda n: F.array_repeat(F.lit(None).cast("tinyint"), n)
    spread = F.flatten(F.transform("m", lambda h, i: F.concat(gap(F.get("at", i) - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.array(code(h)))))
    placed = filled.withColumn("sparse", F.concat(spread, gap(F.lit(BINS - 1) - F.element_at("at", -1))))
    order = lambda b, j: F.xxhash64(b, j)
    first = lambda b: F.array_min(F.transform("at", lambda j: F.struct(order(b, j).alias("o"), j.alias("j")))).getField("j")
    donors = lambda b: [F.get("sparse", _named(b, t)) for t in range(ATTEMPTS)] + [F.get("sparse", first(b))]
    dense = F.transform("sparse", lambda x, b: F.coalesce(x, *donors(b)))
    return placed.withColumn(out, dense).select(*kept, out)


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, corrected for chance agreement, from 0 to 1."""
    same = F.size(F.filter(F.col(a), lambda x, i: x == F.get(F.col(b), i))) / F.lit(float(BINS))
    chance = 2.0**-CODE_BITS
    return F.greatest((same - chance) / (1 - chance), F.lit(0.0))


def packed(codes: str) -> Column:
    """The codes as lower-case hexadecimal digits."""
    return F.array_join(F.transform(codes, lambda x: F.substring(F.lit(_HEX), (x.cast("int") + 128) * 2 + 1, F.lit(2))), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, columns) with next_text and next_<column> of the next row in descending doc_id, cyclically."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = max(RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    shares = [k / ranges for k in range(1, ranges)]
    ids = docs.select("doc_id")
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("cuts")).first().cuts or []))
    heads = ids.withColumn("range", _place(F.col("doc_id"), cuts)).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # a row a range
    before = [(heads[i].head, heads[i - 1].range) for i in range(len(heads))]
    first = spark.createDataFrame(before, "head long, before int")
    met = docs.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("head")), "left").withColumn("range", _place(F.col("doc_id"), cuts))
    spots = F.array_compact(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("r"), F.lit(1).alias("guest")))))
    dealt = met.select("doc_id", "text", *columns, F.explode(spots).alias("spot")).select("doc_id", "text", *columns, "spot.r", "spot.guest")
    inside = Window.partitionBy("r").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.select("doc_id", "text", *columns, "guest", *[F.lead(c).over(inside).alias(f"next_{c}") for c in ("text", *columns)]).where("guest = 0").drop("guest")


def _place(c: Column, cuts: list[int]) -> Column:
    """Number of the range, from the largest ids down, by binary search over the limits, which are one folded literal."""
    if not cuts:
        return F.when(c.isNull(), 1).otherwise(0)
    limits = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) < c, at + step).otherwise(at))
    return F.when(c.isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - below)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts of docs (doc_id, text) and of their edited texts, with likenesses."""
    own = with_codes(with_words(docs), "codes")
    paired = with_next(own, ["codes"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    made = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "codes", "next_codes")
    words = with_words(made.withColumnRenamed("edited", "text"), "n_chars", "codes", "next_codes")
    both = with_codes(words, "edited_codes")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("text", 256).alias("edited_sha256"),
        packed("codes").alias("fingerprint"),
        packed("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"),
        likeness("codes", "next_codes").alias("near_next"),
    )


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
