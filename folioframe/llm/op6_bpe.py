"""BPE encoding and decoding of a table of texts, with the streaming transducer of `bpe`.

Null texts count as empty; repeated rows and repeated ids each give their own row; an empty table gives an empty result;
columns besides the two that are read have no effect.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): each whole text's tokens, and those tokens decoded again."""

    def run(batches):
        coder = bpe.encoder(path)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                tokens = array("I", coder.encode(text or ""))
                ids.append(tokens)
                decoded.append(_decode(coder.merges, tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, ids array<int>, decoded string")


def _decode(merges: bpe.Merges, tokens: array, step: int = 1 << 14) -> str:
    machine = bpe.Decoder(merges)
    return "".join(machine.feed(tokens[at : at + step]) for at in range(0, len(tokens), step)) + machine.finish()


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with counts and digests in place of the tokens and texts themselves, made as they stream by."""

    def run(batches):
        coder = bpe.encoder(path)
        decimal = [str(i) for i in range(max(coder.merges.token_bytes) + 1)].__getitem__
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(coder.merges)
                for packed in coder.stream(text or ""):
                    tokens = array("I", packed)
                    if tokens:
                        of_ids.update(("," * bool(n) + ",".join(map(decimal, tokens))).encode())
                        of_text.update(machine.feed(tokens).encode())
                        n += len(tokens)
                of_text.update(machine.finish().encode())
                counts.append(n)
                ids.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
