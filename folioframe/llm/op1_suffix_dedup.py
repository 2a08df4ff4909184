"""Suffix-array deduplication of exact byte strings: ranks of positions, sorted by Spark, over strings that grow until unique or past the threshold.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier, in document order. To know that, the
positions of all texts must be ranked by their first LENGTH bytes. Textbook prefix doubling sorts (rank, rank at an offset)
of every position in every round, which moves many times the corpus. Here the rounds are sparse: neighbouring positions
share a string as long as they can, and only those that are still in doubt are ranked apart.

1. Anchors. The window of LENGTH bytes at a position holds LENGTH - GRAM + 1 strings of GRAM bytes; the one of least
   hash, the leftmost of equals, is its anchor. Equal windows have their anchors at equal shifts. About one byte in 35
   is an anchor. Spark counts the anchors' strings; unique ones go, and with them all windows around them.
2. A round ranks candidates: an anchor with a range of shifts, at first all of them. The core is what all windows of the
   range have in common (GRAM bytes at first), the hull all their bytes (past LENGTH). Candidates are grouped by the rank
   of their cores. One alone in its group is unique, and so are all its windows: it goes. Of candidates with equal hulls,
   all but the earliest are repeats: all their bytes are removed, and they go. If one hull is left in a group, its
   windows are unique there. Where several are left, each is split into WAYS ranges, and their cores, longer than
   before, are ranked in the next round. A range of one shift has the window itself as core and hull, so rounds end.

Groups are never gathered, whatever their size: counts, least hulls and earliest positions are aggregated before a
shuffle, and joins can split a hot key. Ranks are names of 128 bits, equal for equal strings; the first round's cores have
64, which can only put more candidates in doubt. Tables between steps are in the shared folder. Document order is doc_id,
nulls last, then the text's hash. A document's removed runs are merged in a stream; they and its text are one row.

Null texts count as empty; texts shorter than LENGTH lose nothing; repeated rows and ids count as documents of their
own, in the order above; an empty table gives an empty result; other columns have no effect (and stay, in `deduplicate`,
whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.ordering import numbered
from folioframe.llm.storage import drop_table, free_name, write_table

LENGTH = 100
GRAM = 24
WAYS = 4
CHUNK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, base: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        ones = [np.full(max(n, 1 << 16), x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in ones:
            x[0] = 1
        _POWERS[base] = [np.cumprod(x, dtype=np.uint64) for x in ones]
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Names:
    """64-bit names of substrings of a byte array, under one base."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        up, self.down = _powers(len(data) + 1, base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _told_apart(name: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of a string together with two small numbers."""
    return _mix(name ^ _mix(x.astype(np.uint64) << np.uint64(8) | y.astype(np.uint64)))


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, from running minima of blocks in both directions."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, hulls: bool = True) -> tuple[np.ndarray, ...]:
    """(name of the gram, first window, number of windows, anchor's offset in the first, two names of the hull) of each anchor."""
    parts = []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(whole) - LENGTH + 1), CHUNK):
        part = whole[at : at + CHUNK + LENGTH - 1]
        with np.errstate(over="ignore"):
            names = Names(part)
            grams = names.all(GRAM)
            order = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
            least = (_window_minima(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            change = np.flatnonzero(np.diff(least)) + 1
            first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(least) - 1]])
            anchor = least[first]
            both = (names, Names(part, _BASES[1])) if hulls else ()
            spans = [_told_apart(x.of(first, last + LENGTH), last - first, anchor - first).view(np.int64) for x in both]
        parts.append((grams[anchor].view(np.int64), first + at, last - first + 1, anchor - first, *spans))
    if not parts:
        return (np.empty(0, np.int64),) * (6 if hulls else 4)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _grams(batches):
    """(k) of every anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [anchors((t or "").encode("utf-8", "surrogatepass"), False)[0] for t in batch.column(1).slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["k"])


def _candidates(batches):
    """(k, c1, c2, doc, place) of every anchor, with place = first << 16 | windows << 8 | offset."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [anchors((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
            k, first, n, offset, c1, c2 = (np.concatenate(x) for x in zip(*found, strict=True))
            docs = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, c1, c2, docs, first << 16 | n << 8 | offset)], ["k", "c1", "c2", "doc", "place"])


def _contexts(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, place, context): the bytes of all windows of each anchor in places (doc, place)."""

    def run(batches):
        for batch in batches:
            for doc, text, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    context = [data[p >> 16 : (p >> 16) + (p >> 8 & 255) + LENGTH - 1].tobytes() for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(context, pa.binary())], ["doc", "place", "context"])

    joined = texts.join(places.groupBy("doc").agg(F.collect_list("place").alias("rows")), "doc").select("doc", "text", "rows")
    return joined.mapInArrow(run, "doc long, place long, context binary")


def _split(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the range, least and greatest shift) of the WAYS parts of each range of shifts."""
    step = -(-(hi - lo + 1) // WAYS)
    parent = np.repeat(np.arange(len(lo)), WAYS)
    begin = lo[parent] + step[parent] * np.tile(np.arange(WAYS), len(lo))
    inside = begin <= hi[parent]
    parent, begin = parent[inside], begin[inside]
    return parent, begin, np.minimum(begin + step[parent] - 1, hi[parent])


_ROWS = "k long, k2 long, c1 long, c2 long, doc long, place long, lo long, hi long"


def _ranked(batches):
    """The parts of the ranges lo to hi of (doc, place, context, lo, hi), where the anchor has windows, with names of core and hull."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = batch.slice(at, 4096)
            doc, place, lo, hi = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
            context = rows.column(2).to_pylist()
            begin = np.cumsum([0, *map(len, context)])[:-1]
            parent, lo, hi = _split(lo, hi)
            offset = place & 255
            greatest, least = offset, offset - (place >> 8 & 255) + 1
            own = (lo <= greatest[parent]) & (hi >= least[parent])
            parent, lo, hi = parent[own], lo[own], hi[own]
            a = begin[parent] + offset[parent]
            own_lo, own_hi = np.maximum(lo, least[parent]), np.minimum(hi, greatest[parent])
            data = np.frombuffer(b"".join(context), np.uint8)
            with np.errstate(over="ignore"):
                both = [Names(data, x) for x in _BASES]
                cores = [_told_apart(x.of(a - lo, a - hi + LENGTH), lo, hi).view(np.int64) for x in both]
                hulls = [_told_apart(x.of(a - own_hi, a - own_lo + LENGTH), own_lo, own_hi).view(np.int64) for x in both]
            columns = [*cores, *hulls, doc[parent], place[parent], lo, hi]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "k2", "c1", "c2", "doc", "place", "lo", "hi"])


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of a round's candidates (_ROWS): spans (doc, s, e) of the repeats; (doc, place, lo, hi) of those still in doubt; their tables."""
    first = F.min(F.struct("doc", "place")).alias("first")
    # a hull's name tells its range, and its bytes hold the core, so equal hulls have equal cores
    hulls, hulls_at = write_table(rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), first, *(F.any_value(x).alias(x) for x in ("k", "k2", "lo", "hi"))), "hulls")
    repeats = rows.join(hulls.where("n > 1").select("c1", "c2", "first"), ["c1", "c2"]).where(F.struct("doc", "place") != F.col("first"))
    offset = F.col("place").bitwiseAND(F.lit(255))
    anchor, least = F.shiftright("place", 16) + offset, offset - F.shiftright("place", 8).bitwiseAND(F.lit(255)) + 1
    spans = repeats.select("doc", (anchor - F.least("hi", offset)).alias("s"), (anchor - F.greatest("lo", least) + LENGTH).alias("e"))
    spans, spans_at = write_table(spans, "spans")
    several = hulls.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    live = hulls.where("lo < hi").join(several, ["k", "k2"], "left_semi").select("first.doc", "first.place", "lo", "hi")
    live, live_at = write_table(live, "live")
    drop_table(rows.sparkSession, hulls_at)
    return spans, live, [spans_at, live_at]


def _merged(batches):
    """(doc, spans) of rows (doc, s, e), which come sorted: each document's maximal runs."""
    now, runs = None, []

    def row():
        return pa.RecordBatch.from_pylist([{"doc": now, "spans": runs}], pa.schema([("doc", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))]))

    for batch in batches:
        for doc, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc != now:
                if runs:
                    yield row()
                now, runs = doc, []
            if runs and s <= runs[-1]["e"]:
                runs[-1]["e"] = max(runs[-1]["e"], e)
            else:
                runs.append({"s": s, "e": e})
    if runs:
        yield row()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, spans array<struct<s, e>>): the maximal runs of repeated bytes, of texts (doc: unique and in order, text) that have any."""
    spark = texts.sparkSession
    texts = texts.select("doc", "text").where("text is not null")
    repeated = texts.mapInArrow(_grams, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    repeated, repeated_at = write_table(repeated, "grams")
    every = texts.mapInArrow(_candidates, "k long, c1 long, c2 long, doc long, place long").join(repeated, "k", "left_semi")
    rows, rows_at = write_table(every, "anchors")
    drop_table(spark, repeated_at)
    rows = rows.select("k", F.lit(0).cast("long").alias("k2"), "c1", "c2", "doc", "place", F.lit(0).cast("long").alias("lo"), F.lit(LENGTH - GRAM).cast("long").alias("hi"))
    found, live, tables = _settle(rows)
    drop_table(spark, rows_at)
    context, context_at = write_table(_contexts(live, texts), "contexts")
    while not live.isEmpty():
        ranked = context.join(live, ["doc", "place"]).mapInArrow(_ranked, _ROWS)
        rows, rows_at = write_table(ranked, "ranked")
        spans, live, more = _settle(rows)
        found = found.unionByName(spans)
        tables += more
        drop_table(spark, rows_at)
    sorted_ = found.repartition("doc").sortWithinPartitions("doc", "s")
    runs, _ = write_table(sorted_.mapInArrow(_merged, "doc long, spans array<struct<s: long, e: long>>"), "repeated")
    drop_table(spark, context_at, *tables)
    return runs


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def _runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(x["s"], x["e"]) for x in spans or ()]


def _with_spans(docs: DataFrame, id_col: str) -> DataFrame:
    """The columns of docs, and last the array of what repeats in each text, or null."""
    named, number = numbered(docs, id_col)
    spans = repeated_spans(named.select(F.col(number).alias("doc"), "text"))
    own = free_name(named.columns, "folioframe_spans")
    return named.join(spans.select(F.col("doc").alias(number), F.col("spans").alias(own)), number, "left").select(*docs.columns, own)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = (text or "").encode("utf-8", "surrogatepass"), _runs(spans)
                rows.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest()))
            n, removed, spans, digest = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with repeated strings cut out of the column text, other columns as they are; bytes of a torn character go too; nulls stay."""
    names = list(docs.columns)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                runs = _runs(spans)
                texts.append(without(text.encode("utf-8", "surrogatepass"), runs).decode("utf-8", "ignore") if runs else text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(names)

    return _with_spans(docs, id_col).mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what exact substring deduplication at 100 bytes removes."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
