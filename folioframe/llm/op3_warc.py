"""WARC archives with a two-level capture index.

Writing. Captures are dealt to ranges of their keys and sorted: a key is the URL with its host reversed
(`com,example,www)/path`), a blank, and the capture's number, so a host or URL of any size is split. Each range is an
archive of gzip members, a record each, beside an index of its sorted keys in compressed blocks of BLOCK lines, and a
sparse directory with the first key of each block. Of equal payloads the capture that comes last in document order (the
largest page_id) is stored; the others are revisits that keep headers only.

Reading. A lookup finds its archive by binary search over the ranges' first keys (one a range, the only thing sent to
all), its block over the directory, and its line in the block; then it reads the record's bytes and no others. Lookups
come sorted, so neighbours share a block.

Tasks write files of new names in the shared folder and only those that a finished task reports are in the directory
table, so lost executors and repeated attempts do no harm.

A null payload is empty, a null URL is the empty URL; null ids come last in document order; of repeated ids and equal
payloads one row is the response; an empty table gives an empty archive; other columns have no effect.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.ordering import NUMBER, numbered
from folioframe.llm.storage import fresh_path, write_table

BLOCK = 300
LEAST = 0
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"


def reversed_host_key(url: str) -> Column:
    """`com,example,www)/path?query` of a URL column; what has no host is kept after a bare parenthesis."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(whole, _URL, 1))
    rest = F.when(host == "", whole).otherwise(F.regexp_extract(whole, _URL, 2))
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20]", "+")


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _header(value) -> str:
    return quote(str(value), safe="!#$%&'()*+,/:;=?@[]~|{}^`\"<>\\")


def record(number: int, page: int | None, url: str | None, payload: bytes, refers: tuple[int, int | None] | None) -> bytes:
    """One WARC record as a gzip member; refers: number and id of the capture that a revisit repeats."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:capture:{number}>", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:capture:{refers[0]}>"] + [f"X-Refers-To-Page: {refers[1]}"] * (refers[1] is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record: number, page_id, url, payload (None of a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated):
        raise ValueError(f"capture {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return {
        "number": int(fields["WARC-Record-ID"][13:-1]),
        "page_id": None if page is None else int(page),
        "url": unquote(fields["WARC-Target-URI"]),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers) if revisit and refers is not None else None,
    }


def _key(key: str, number: int) -> str:
    return f"{key} {number + (1 << 63):020d}"


class _Index:
    """Sorted keys into compressed blocks."""

    def __init__(self, sink):
        self.sink, self.lines, self.at, self.directory = sink, [], 0, []

    def add(self, key: str, offset: int, length: int) -> None:
        self.lines.append(f"{key} {offset} {length}\n")
        if len(self.lines) == BLOCK:
            self.close()

    def close(self) -> None:
        if self.lines:
            block = zlib.compress("".join(self.lines).encode("utf-8", "surrogatepass"))
            self.directory.append((" ".join(self.lines[0].split(" ")[:2]), self.at, len(block), len(self.lines)))
            self.sink.write(block)
            self.at += len(block)
            self.lines = []


def write(pages: DataFrame, archive: str, least: int = LEAST) -> DataFrame:
    """Write pages (NUMBER, page_id, url, html) below the URI `archive`; the directory table (first, part, offset, length, lines)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sums = pages.select(NUMBER, "page_id", F.sha1(payload).alias("sum"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    last = F.max(F.struct(F.col(NUMBER).alias("number"), "page_id"))
    groups = sums.groupBy("sum", "n").agg(F.count(F.lit(1)).alias("copies"), last.alias("last")).where("copies > 1").select("sum", "n", "last")
    revisits = sums.join(groups, ["sum", "n"]).where(F.col(NUMBER) != F.col("last.number")).select(NUMBER, F.col("last.number").alias("to_number"), F.col("last.page_id").alias("to_page"))
    revisits, _ = write_table(revisits, "revisits")  # its size is then known: where it is small, payloads are shuffled once
    rows = pages.join(revisits, NUMBER, "left").select(reversed_host_key("url").alias("key"), F.col(NUMBER).alias("number"), "page_id", "url", payload.alias("payload"), "to_number", "to_page")
    sorted_ = rows.repartitionByRange("key", "number").sortWithinPartitions("key", "number")

    def run(batches):
        store, folder = _files(archive)
        store.create_dir(folder, recursive=True)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        warc = sink = index = None
        at = 0
        for batch in batches:
            for key, number, page, url, body, to_number, to_page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if warc is None:
                    warc, sink = store.open_output_stream(f"{folder}/{part}.warc.gz", compression=None), store.open_output_stream(f"{folder}/{part}.idx")
                    index = _Index(sink)
                member = record(number, page, url, body, None if to_number is None else (to_number, to_page))
                warc.write(member)
                index.add(_key(key, number), at, len(member))
                at += len(member)
        if warc is not None:
            index.close()
            warc.close()
            sink.close()
            with store.open_output_stream(f"{folder}/{part}.dir") as out:
                out.write("".join(f"{first} {o} {n} {lines}\n" for first, o, n, lines in index.directory).encode("utf-8", "surrogatepass"))
            first, offset, length, lines = zip(*index.directory, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array([part] * len(first)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(lines, pa.int64())], ["first", "part", "offset", "length", "lines"])

    return write_table(sorted_.mapInArrow(run, "first string, part string, offset long, length long, lines long"), "directory")[0]


class Reader:
    """Lookups by binary search and range reads; keeps the directory of one archive part and one block at a time."""

    def __init__(self, archive: str, starts: list[tuple[str, str]]):
        self.store, self.folder = _files(archive)
        self.firsts, self.parts = [x[0] for x in starts], [x[1] for x in starts]
        self.part = self.block = None

    def _open(self, part: str) -> None:
        if part != self.part:
            with self.store.open_input_file(f"{self.folder}/{part}.dir") as f:
                rows = [x.rsplit(" ", 3) for x in f.read().decode("utf-8", "surrogatepass").split("\n")[:-1]]
            self.directory, self.places = [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows]
            self.index, self.warc = (self.store.open_input_file(f"{self.folder}/{part}.{x}") for x in ("idx", "warc.gz"))
            self.part, self.block = part, None

    def find(self, key: str) -> dict | None:
        """The record of a key, or None."""
        i = bisect.bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        self._open(self.parts[i])
        j = bisect.bisect_right(self.directory, key) - 1
        if j < 0:
            return None
        if j != self.block:
            offset, length = self.places[j]
            lines = zlib.decompress(self.index.read_at(length, offset)).decode("utf-8", "surrogatepass").split("\n")[:-1]
            self.lines = [x.rsplit(" ", 2) for x in lines]
            self.keys, self.block = [x[0] for x in self.lines], j
        k = bisect.bisect_left(self.keys, key)
        if k == len(self.keys) or self.keys[k] != key:
            return None
        return parse(self.warc.read_at(int(self.lines[k][2]), int(self.lines[k][1])))


def lookup(queries: DataFrame, archive: str, directory: DataFrame, whole: bool = False) -> DataFrame:
    """The records of queries (url, NUMBER) that the archive has; a key that it lacks is an error if it has to be whole."""
    least = directory.groupBy("part").agg(F.min("first").alias("first"))
    starts = sorted((r.first_, r.part) for r in least.withColumnRenamed("first", "first_").collect())  # a row an archive part
    keyed = queries.select(reversed_host_key("url").alias("key"), F.col(NUMBER).alias("number"))
    keyed = keyed.repartitionByRange(max(1, len(starts)), "key", "number").sortWithinPartitions("key", "number")  # a task an archive part
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        reader = Reader(archive, starts)
        for batch in batches:
            keys = [_key(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [reader.find(x) for x in keys]
            if whole and None in found:
                raise ValueError(f"the archive lacks the capture {keys[found.index(None)]!r}")
            found = [x for x in found if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, kinds, strict=True)], names)

    return keyed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page's record, written to a new archive in the shared folder and looked up there again."""
    archive = fresh_path(pages.sparkSession, "warc")
    own, _ = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id", "html")
    return lookup(own, archive, write(own, archive), whole=True)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, from the archive."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of SHA-1 by five hexadecimal digits a step: 20 bits, four letters.
_FIVE = "CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((" + _FIVE + " >> {}) & 31) AS BIGINT), 1)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {' || '.join(_LETTER.format(b) for b in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""
