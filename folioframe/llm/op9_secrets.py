"""Secret scans with one combined deterministic automaton.

Each rule has a core, the shortest beginning that tells it from other text. The cores of all rules are compiled into one
minimal automaton, which reads every byte once. Where a core ends, the rule's own reversed automaton finds the leftmost
beginning and its forward automaton the longest end. Per rule, matches do not overlap, and one that fails its rule's
least length is dropped after it has used up its text.

Null texts count as empty; repeated rows each give a row; an empty table gives an empty result; other columns have no
effect. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.automata import Automaton, backwards, parse

BASE = ("assign", "access", "hex")
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """least: bytes that the match needs, or the part of it after the head if there is one. The rest of a match is of ASCII."""

    kind: str
    pattern: str
    core: str
    least: int
    any_case: bool = False
    head: str = ""


_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Fixed patterns: the three that the contract states, then public formats of keys and tokens.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=\\-]+", _ASSIGN + "[A-Za-z0-9+/_.=\\-]", 8, True, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{8}", 32),
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", "xox[abprs]-[A-Za-z0-9\\-]", 24),
    Rule("google", "AIza[A-Za-z0-9_\\-]+", "AIza[A-Za-z0-9_\\-]", 39),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", "[sr]k_live_[A-Za-z0-9]", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]", 40),
    Rule("login_url", "[a-z]+://[^\\x00-\\x20:/@]+:[^\\x00-\\x20:/@]+@", "://[^\\x00-\\x20:/@]+:[^\\x00-\\x20:/@]+@", 0),
)


class Scanner:
    """All rules, compiled once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.any_case) for r in rules]
        self.combined = Automaton([parse(r.core, r.any_case) for r in rules], floating=True)
        self.forward = [Automaton([t], floating=False) for t in trees]
        self.reverse = [Automaton([backwards(t)], floating=False) for t in trees]
        self.heads = [Automaton([parse(r.head, r.any_case)], floating=False) if r.head else None for r in rules]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule's place, end) in code points, by start and then by rule."""
        data = text.encode("utf-8", "surrogatepass")
        found, used = [], [0] * len(self.rules)
        for at, which in self.combined.hits(data):
            for k in which:
                if at < used[k]:
                    continue
                back = self.reverse[k].longest(memoryview(data)[used[k] : at + 1][::-1])
                if back < 0:
                    continue
                start = at + 1 - back
                view = memoryview(data)[start:]
                used[k] = start + self.forward[k].longest(view)
                size = used[k] - start
                if self.heads[k] is not None:
                    size -= self.heads[k].longest(view)
                if size >= self.rules[k].least:
                    found.append((start, k, used[k]))
        if found and len(data) != len(text):
            places = sorted({x for s, _, e in found for x in (s, e)})
            points, done, n = {}, 0, 0
            for p in places:
                n += len(data[done:p].decode("utf-8", "replace"))
                points[p], done = n, p
            found = [(points[s], k, points[e]) for s, k, e in found]
        return sorted(found)


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every stretch that spans cover replaced by the mask."""
    out, done = [], 0
    start = end = None
    for s, _, e in [*spans, (len(text) + 1, 0, 0)]:
        if end is not None and s > end:
            out += [text[done:start], mask]
            done, end = end, None
        start, end = (s, e) if end is None else (start, max(end, e))
    return "".join([*out, text[done:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) by start and then by rule, for every row."""

    def run(batches):
        own = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[(rules[k].kind, s, e) for s, k, e in own.scan(t or "")] for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """df with each secret in its text replaced by the mask; null texts stay null, all other columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batches):
        own = scanner(rules)
        for batch in batches:
            texts = [t and redacted(t, own.scan(t), mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x.kind.isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
