import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import bpe, op5_packing, op6_bpe

PATH = op6_bpe.vocabulary()
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'", "'re", "é", "ß", "1", "23", "!", "***", "　", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|endo", "<", "中", "😀", "aaaaaaaa", " " * 50, "\r\n", "​", "½", "ⅷ", "_"]


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "x" * 30000, " " * 9000 + "x", "ab" * 9000 + "'s", "1" * 5000 + " " * 3000]
    return out + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block", [1 << 16, 7, 64, 1500])
def test_stream_equals_library(library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    coder = bpe.encoder(PATH)
    for text in texts():
        ids = np.frombuffer(coder.encode(text or ""), "<u4").tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        machine = bpe.Decoder(coder.merges)
        assert "".join(machine.feed(ids[i : i + 2]) for i in range(0, len(ids), 2)) + machine.finish() == library.decode(ids, skip_special_tokens=False)


def test_lookahead_suffices():
    merges, rng = bpe.encoder(PATH).merges, random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aeinorst") for _ in range(1000)).encode()
        short, whole = merges.merge(word[:700]), merges.merge(word)
        end = 0
        for a, b in zip(short, whole, strict=False):
            end += len(merges.token_bytes[a])
            if end > 700 - merges.lookahead:
                break
            assert a == b


def test_torn_characters():
    merges = bpe.encoder(PATH).merges
    machine = bpe.Decoder(merges)
    half = [merges.byte_id[b] for b in "é".encode()]
    assert machine.feed(half[:1]) == "" and machine.feed(half[1:]) == "é"
    assert machine.feed(half[:1]) + machine.finish() == "�"


def test_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x y"), (3, "x y"), (3, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("length", F.lit(1))
    got = sorted(map(tuple, op6_bpe.digests(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *digest))
    assert got == sorted(want, key=str)
    assert op6_bpe.digests(df.limit(0), PATH).count() == 0
    whole = op6_bpe.encode(df.where("doc_id = 4"), PATH).collect()[0]
    assert whole.decoded == texts()[4]


def test_packing(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    pieces = op5_packing.pack(df, PATH).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids
        for p in own:
            assert p.length == len(p.ids) == 1 << p.bucket <= 1024 and p.offset == 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.start == sum(q.length for q in own if q.start < p.start)
    assert op5_packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        op5_packing.pack(df, PATH, longest=1000)


def test_binary_lengths():
    for n in range(1, 5000, 7):
        cut = op5_packing.binary_lengths(n)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 for x in cut)


def test_buckets_and_merge_order(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, "word " * i) for i in range(0, 90, 7)], "doc_id long, text string")
    pieces = op5_packing.pack(df, PATH)
    back = op5_packing.bucketed(pieces, f"file://{tmp_path}/packed")
    assert sorted(map(str, back.drop("sequence_id").collect())) == sorted(map(str, pieces.drop("sequence_id").collect()))
    lengths = {(r.bucket, r.length) for r in back.collect()}
    assert all(length == 1 << bucket for bucket, length in lengths) and len({f.name for f in (tmp_path / "packed").glob("bucket=*")}) == len(lengths)
    whole = json.load(open(PATH, encoding="utf-8"))
    first, second = ("".join(m if isinstance(m, list) else m.split(" ")) for m in whole["model"]["merges"][:2])
    ids = whole["model"]["vocab"]
    ids[first], ids[second] = ids[second], ids[first]
    (tmp_path / "swapped.json").write_text(json.dumps(whole), encoding="utf-8")
    other = Tokenizer.from_file(str(tmp_path / "swapped.json"))
    coder = op5_packing.tokenizer(str(tmp_path / "swapped.json"))
    assert not coder.in_order
    for text in ("the then there in on at", "an unexpected interning"):
        assert coder.ids(text).tolist() == other.encode(text, add_special_tokens=False).ids
