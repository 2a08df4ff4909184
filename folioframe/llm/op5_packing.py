"""Packing by power-of-two decomposition.

A document's ids (and the end id) are cut into pieces of binary lengths: as many of the longest as fit, then one for
each bit of what is left. A piece is a sequence by itself, so no sequence crosses documents and none is padded. Pieces
are dealt into buckets of equal length, folders of one table, so that batches of equal tokens can be drawn from each;
tasks write them where they cut them, nothing is shuffled.

Null texts count as empty (one piece that holds the end id); repeated rows are packed each for itself; an empty table
gives no pieces; columns besides the two that are read have no effect.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe
from folioframe.llm.op6_bpe import vocabulary
from folioframe.llm.storage import fresh_path

LONGEST = 1024
END_ID = 0
#: Words beyond this many characters go to the streaming encoder, whose time and memory a word's length doesn't square.
LONG_WORD = 2048


class Tokenizer:
    """The same ids as the tokenizers library gives for a byte-level BPE file, without special tokens added."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters = bpe._byte_letters()
        ids = whole["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in ids.items()}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in whole["model"]["merges"]]
        #: Ids serve as ranks only if they rise along the merge list; else the encoder that reads the list does all.
        self.in_order = all(a < b for a, b in zip(merged, merged[1:], strict=False))
        special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.coder = tiktoken.Encoding("file", pat_str=bpe.WORD, mergeable_ranks={b: i for b, i in ranks.items()}, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if not self.in_order or len(text) > LONG_WORD and (max(map(len, text.split(" "))) > LONG_WORD or " " * LONG_WORD in text):
            return np.frombuffer(bpe.encoder(self.path).encode(text), "<u4")
        return np.asarray(self.coder.encode(text, allowed_special="all"), "<u4")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to n, the longest first: n // longest of the longest, then the bits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and ids.

    longest: a power of two. sequence_id is unique, and the same whenever a lost task of the same scan runs again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches):
        coder = tokenizer(path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(coder.ids(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                start = 0
                for n in binary_lengths(len(ids), longest):
                    piece = ids[start : start + n]
                    for column, x in zip(rows, (doc, start, n, zlib.crc32(piece), len(ids), piece), strict=False):
                        column.append(x)
                    start += n
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=False)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    bucket = F.length(F.bin("length")) - 1
    made = [F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket")]
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *made, *["ids"] * with_ids)


def bucketed(pieces: DataFrame, path: str) -> DataFrame:
    """pieces written below path, a folder for each bucket, and read again: a filter on bucket reads that folder only."""
    pieces.write.partitionBy("bucket").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(pieces.columns)


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), with_ids=False)
    return bucketed(pieces, fresh_path(spark, "packed"))
