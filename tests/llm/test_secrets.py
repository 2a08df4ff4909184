import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import op9_secrets as op
from folioframe.llm.automata import Automaton, parse

PLAIN = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
PARTS = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "apiKey", "'", '"', " ", "  ", ":", "=", "a1", "abcdefgh", "deadbeef", "0123456789abcdef" * 2, "AKIA", "AKIAZZ9", "ABCDEFGHIJKLMNOP", "é", "ſ", "K", "\n", ".", "-", "ghp_" + "a1B2" * 9, "eyJab.eyJcd.", "https://u:p@h", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-", "sk_live_", "1234567890123456789012345"]


def plain(text):
    found = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m):
                found.append((m.start(), place, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def mine(text):
    return [(op.RULES[k].kind, s, e) for s, k, e in op.scanner().scan(text) if op.RULES[k].kind in op.BASE]


def test_base_kinds_against_plain_expressions():
    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert mine(text) == plain(text), text


@settings(max_examples=300, deadline=None)
@given(st.text("abf01=AKIZtoken: \n", max_size=80))
def test_any_text(text):
    assert mine(text) == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["a(b|c)*d", "(ab|a)(bc)?", "a+b?c{3}", "[^a-c]+x", "(a|b)*abb"]), st.text("abcdx", max_size=20))
def test_automaton_equals_expression(pattern, text):
    whole = Automaton([parse(pattern)], floating=False)
    ends = [e for e in range(len(text) + 1) if re.fullmatch(pattern, text[:e])]
    assert whole.longest(text.encode()) == max(ends, default=-1)
    floating = Automaton([parse(pattern)], floating=True)
    got = {i for i, _ in floating.hits(text.encode())}
    assert got == {e - 1 for e in range(1, len(text) + 1) if any(re.fullmatch(pattern, text[s:e]) for s in range(e))}


def test_minimal():
    assert len(Automaton([parse("(a|b)*abb")], floating=False).table) == 5  # the four of the textbook and the dead one for other bytes


def test_added_kinds_and_redaction():
    text = "é key ghp_" + "a1B2" * 9 + " then postgres://user:hunter2@host and -----BEGIN RSA PRIVATE KEY----- end"
    spans = op.scanner().scan(text)
    assert [op.RULES[k].kind for _, k, _ in spans] == ["github", "login_url", "private_key"]
    assert op.redacted(text, spans) == "é key [secret] then [secret]host and [secret] end"
    assert op.redacted("token=0123456789abcdef0123456789abcdef!", op.scanner().scan("token=0123456789abcdef0123456789abcdef!")) == "[secret]!"
    assert op.redacted("plain", []) == "plain"


def test_rows(spark):
    rng = random.Random(9)
    texts = [None, "", "x" * 3_000_000 + " password = 'abcdefgh1' " + "0" * 40] + ["".join(rng.choice(PARTS) for _ in range(12)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[4]), (3, texts[4]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("kind", F.lit(1))
    got = op.scan(df).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=str), sorted(((i, t) for i, t in rows), key=str), strict=False):
        assert r.doc_id is None or isinstance(r.doc_id, int)
    by = sorted((str(r.doc_id), [(x.kind, x.start, x.end) for x in r.spans if x.kind in op.BASE]) for r in got)
    assert by == sorted((str(i), plain(t or "")) for i, t in rows)
    assert op.scan(df.limit(0)).count() == 0
    clean = op.redact(df)
    assert clean.columns == df.columns and clean.where("text is null").count() == 1
    assert all(plain(r.text or "") == [] for r in clean.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op.op9_secret_scan(spark, sf).collect():
        want = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in want) for k in op.BASE)
