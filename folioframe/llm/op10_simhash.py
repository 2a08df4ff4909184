"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of up to RADIUS differing bits are linked. Bit i of a fingerprint has a vector m(i) in {0,1}^(RADIUS+1);
for each vector v but zero there is a table, whose key keeps the bits i with an odd inner product of m(i) and v. The
m(i) of up to RADIUS differing bits leave some v with inner products zero, whose key drops all of them: every linked
pair meets in some table, with certainty. In each bucket a search from fingerprint to fingerprint, over exact distances,
gives a spanning forest, never all pairs. Buckets beyond BLOCK fingerprints are dealt out as pairs of blocks, exactly.
Copies of a fingerprint take part once. Components are then found in joins.

Null texts have no words and so fingerprint zero, which is linked like any other. Repeated rows each give a row. A null
doc_id is never a component's id unless the component has no other. An empty table gives an empty result. Other columns
have no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.components import components
from folioframe.llm.ordering import numbered
from folioframe.llm.storage import drop_table, write_table

RADIUS = 4
WORDS = 4
SEED = 42
BLOCK = 4096
HASHES_AT_ONCE = 1 << 16
_ALL = (1 << 64) - 1


def simhash(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a whole text: A-Z lower-cased, words joined by spaces, a bit 1 if set in over half the hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, ends, at = b" ".join(found), [], -1
    for x in found:
        at += len(x) + 1
        ends.append(at)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts, ends = [0] + [e + 1 for e in ends[: len(ends) - words]], ends[words - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), HASHES_AT_ONCE):
        some = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + HASHES_AT_ONCE], ends[k : k + HASHES_AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, unsigned."""
    most = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (i % most + 1 & v).bit_count() & 1) for v in range(1, most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within radius of each other; each is compared with those not yet reached."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                reached = left[near]
                out += [(int(x), int(y)) for y in reached]
                queue += list(reached)
                left = left[~near]
    return out


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(src, dst): links between the distinct fingerprints (column fp) that leave no component of the relation apart."""
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the exploded rows for as small as the fingerprints and would broadcast them through the driver
    shared = rows.hint("merge").join(sizes.hint("merge"), "bucket").withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), "blocks")
    pair = lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))
    dealt = shared.select("fp", "bucket", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("p"))
    keyed = dealt.select(F.xxhash64("bucket", "p.i", "p.j").alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches):
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in (*batches, None):
            if batch is None:
                keys, fps, ends = rest_k, rest_f, [len(rest_k)] * bool(len(rest_k))
            else:
                keys, fps, ends = np.concatenate([rest_k, batch.column(0).to_numpy()]), np.concatenate([rest_f, batch.column(1).to_numpy()]), []
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), *ends]
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a == 2:
                    if (int(fps[a]) ^ int(fps[a + 1])) & _ALL and ((int(fps[a]) ^ int(fps[a + 1])) & _ALL).bit_count() <= radius:
                        found.append((int(fps[a]), int(fps[a + 1])))
                elif b - a > 2:
                    found += [(_signed(x), _signed(y)) for x, y in spanning_links(fps[a:b].view(np.uint64), radius)]
            rest_k, rest_f = keys[cuts[-1] :], fps[cuts[-1] :]
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    return keyed.mapInArrow(run, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id): every row's fingerprint and the smallest doc_id that links lead to."""
    spark = df.sparkSession
    prints, _ = write_table(fingerprints(df, id_col, text_col), "simhash")
    distinct, distinct_at = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius))
    with_root = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = write_table(with_root.join(least, "root").select("fp", "component_id"), "simhash-components")
    drop_table(spark, distinct_at)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The first row, in document order, of each component; all columns as they are."""
    named, number = numbered(docs, id_col)
    groups = near_duplicates(named, number, "text", radius)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(number))
    return named.join(first, number, "left_semi").select(*[named[c] for c in docs.columns])


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprint, and the component of fingerprints at 4 or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
