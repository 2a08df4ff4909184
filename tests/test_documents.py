import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.__main__ import main
from folioframe.document import Block, Builder, Document, frame
from folioframe.functions import markup, prose
from folioframe.operators import boxes, convert, documents, images, signals
from folioframe.operators.recognize import StubSession, session
from folioframe.plans import graph
from folioframe.sdk import EventBus, Folio
from folioframe.sources import models
from folioframe.streaming import front


def built():
    return Builder(language="en").page(10, 20).heading(2, "Title").paragraph("A & b").display_formula("x^2").items(["one", "two"]).table([["a", "b"]]).quote([Block("paragraph", "q")], "me").code("f()", "py").figure("cap").rule().build()


def test_builder_and_json():
    d = built()
    assert d.block_count() == 9 and d.get_block(0, 99) is None and d.get_block(0, 0).kind == "heading"
    assert d.text() == "Title\nA & b\nx^2\none\ntwo\nq\nf()\n---\n"
    assert Document.from_json(d.to_json()) == d and [b.inlines() for b in d.all_blocks()][5] == ["q"]


def test_printing(spark):
    blocks = frame(spark, {7: built()})
    md = documents.markdown(blocks).first().body
    assert md.startswith("## Title\n\nA & b\n\n$$x^2$$\n\n- one")
    assert "| a | b |\n| --- | --- |" in md and md.endswith("---")
    assert "<p>A &amp; b</p>" in documents.html(blocks).first().body
    pdf = bytes(documents.pdf(blocks).first().pdf)
    start = int(pdf.split(b"startxref\n")[1].split(b"\n")[0])
    assert pdf[start : start + 4] == b"xref" and documents.pdf_bytes(["a(b)"]).count(b"a\\(b\\)") == 1
    assert Folio(blocks).to_all(("markdown", "svg")).count() == 2
    with pytest.raises(ValueError):
        Folio(blocks).to("doc")


def test_printers_keep_structure(spark):
    made = Builder().heading(1, "H").items(["one two", "three"], ordered=True).items(["a"]).table([["a b", "c"], ["d", "e & f"]]).code("x <- 1", "r").code("y").quote([Block("paragraph", "q1"), Block("paragraph", "q2")], "me").figure("").paragraph("see $\\alpha$ here").display_formula("\\frac12").build()
    blocks = frame(spark, {3: made})
    assert documents.markdown(blocks).first().body == "# H\n\n1. one two\n2. three\n\n- a\n\n| a b | c |\n| --- | --- |\n| d | e & f |\n\n```r\nx <- 1\n```\n\n```\ny\n```\n\n> q1\n> q2\n> — me\n\n![]()\n\nsee $\\alpha$ here\n\n$$\\frac12$$"
    tex = documents.latex(blocks, preamble=False).first().body
    assert "\\begin{enumerate}\n\\item one two\n\\item three\n\\end{enumerate}" in tex and "\\begin{itemize}\n\\item a\n\\end{itemize}" in tex
    assert "\\begin{tabular}{|c|c|}\na b & c \\\\\nd & e & f \\\\\n\\end{tabular}" in tex and "\\begin{lstlisting}[language=r]\nx <- 1" in tex and "verbatim}\ny" in tex and "figure" not in tex
    page = documents.html(blocks, page=False).first().body
    assert "<ol><li>one two</li><li>three</li></ol>" in page and "<thead><tr><th>a b</th><th>c</th></tr></thead><tbody><tr><td>d</td><td>e &amp; f</td></tr></tbody>" in page
    assert '<code class="language-r">x &lt;- 1</code>' in page and "<blockquote><p>q1</p><p>q2</p><p>— me</p></blockquote>" in page
    typst = documents.typst_document(blocks).first().body
    assert "+ one two\n+ three" in typst and "#table(columns: 2, [a b], [c], [d], [e & f])" in typst and "see $alpha$ here" in typst and "$ frac(1, 2) $" in typst
    xml = documents.mathml(blocks).first().body
    assert xml.startswith("<math xmlns=") and "<mtext>see </mtext>" in xml and "<inlinemath>\n<mi>α</mi>\n</inlinemath>" in xml and "<displaymath>\n<mfrac><mn>1</mn><mn>2</mn></mfrac>\n</displaymath>" in xml
    assert "<mml:mfrac>" in documents.mathml(blocks, "mml").first().body and "<m:oMathPara" in documents.omml(blocks).first().body
    assert documents.syntax(blocks, "typst").first().body == "see $\\alpha$ here\n\n$ frac12 $" and documents.syntax(blocks).first().body.endswith("$$\n\\frac12\n$$")
    back = documents.from_json(documents.to_json(blocks))
    assert sorted(map(str, back.collect())) == sorted(map(str, blocks.collect()))
    assert documents.render_counts(blocks).first().nodes == 2 and Folio(blocks).to_all().count() == len(Folio(blocks).to_all().select("format").distinct().collect())


def test_long_cycles(spark):
    ring = [("ring", "n%d" % i, "n%d" % ((i + 1) % 25)) for i in range(25)] + [("line", "a", ""), ("line", "b", "a"), ("gap", "x", "nowhere")]
    assert [r.pipeline for r in graph.cyclic_pipelines(spark.createDataFrame(ring, "pipeline string, name string, dep string")).collect()] == ["ring"]


def test_ampersands_and_letterbox(spark):
    cases = {"a & b": "a \\quad  b", "x \\& y": "x \\& y", "x \\\\& y": "x \\\\\\quad  y", "p & \\begin{m} a & b \\end{m} & q": "p \\quad  \\begin{m} a & b \\end{m} \\quad  q"}
    for text, want in cases.items():
        assert spark.range(1).select(markup.space_alignment(F.lit(text)).alias("s")).first().s == want
    out, scale, x, y = images.letterbox(np.zeros((7, 10, 1), np.uint8), 8)
    assert (scale, x, y) == (0.8, 0, 1) and (out[:, 0, 0] == 0).sum() == 6


def test_edits(spark):
    blocks = frame(spark, {1: built()})
    edits = spark.createDataFrame([(1, 1, "replace_text", 0, 1, "new"), (1, 2, "remove_block", 0, 2, None)], "doc_id long, seq int, type string, page_idx int, ord int, text string")
    out = {r.ord: r.text for r in documents.apply_edits(blocks, edits).collect()}
    assert out[1] == "new" and 2 not in out and len(out) == 8


def test_markdown():
    text = "# H\nfirst $a$ line\n$$x$$ after\n\nmid # not heading"
    assert prose.from_markdown(text) == [("heading", 1, "H", False), ("paragraph", 0, "first $a$ line", False), ("formula", 0, "x", True), ("paragraph", 0, "after", False), ("paragraph", 0, "mid # not heading", False)]
    assert prose.markdown_to_latex("# H\n\n$$x$$") == "# H\n\n$$x$$"
    assert prose.from_latex_document("a $x$ b $$y$$") == [("paragraph", 0, "a", False), ("formula", 0, "x", False), ("paragraph", 0, "b", False), ("formula", 0, "y", True)]


def test_repair(spark):
    cases = {"\\frac{a}{b}": "$$ \\frac{a}{b} $$", "x^^2": "$$ x^2 $$", "\\sqrt{x": "$$ \\sqrt{x} $$", "\\left( x": "$$ ( x $$", "a & b": "$$ a \\quad  b $$", "$x$": "$x$", "é \\left( ü": "$$ é ( ü $$", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", markup.repair(F.col("t")).alias("r"), markup.repair(F.col("t"), compat=True).alias("c"))
    for r in df.collect():
        assert r.r == cases[r.t]
    assert "\\frac{}{a}{b}" in [r.c for r in df.collect() if r.t == "\\frac{a}{b}"][0]


def test_spaces(spark):
    cases = {"ab中文cd": "ab 中文 cd", "a,b": "a, b", "你好,世界": "你好, 世界"}
    for text, want in cases.items():
        assert spark.range(1).select(markup.insert_spaces(F.lit(text)).alias("s")).first().s == want


def test_nms_properties(spark):
    rng = random.Random(1)
    rows = [(i % 5, i, rng.random() * 50, rng.random() * 50, 10 + rng.random() * 30, 10 + rng.random() * 30, rng.random(), 0, "a") for i in range(120)] + [(9, 1, 0.0, 0.0, 1.0, 1.0, math.nan, 0, "a")]
    df = spark.createDataFrame(rows, "image_id long, box_id int, x double, y double, w double, h double, confidence double, class_id int, class_name string")
    once = boxes.suppress(df)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, boxes.suppress(once).collect()))
    from folioframe.functions import geometry as g

    worst = boxes.pairs(once).select(F.max(g.iou(F.col("a"), F.col("b"))).alias("m")).first().m
    assert worst <= boxes.NMS_OVERLAP


def test_grouping(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, 12.0, 1.0, 10.0, 10.0, 0.9), (1, 3, 200.0, 0.0, 10.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "image_id long, box_id int, x double, y double, w double, h double, confidence double")
    got = sorted(map(tuple, boxes.group_nearby(df).collect()))
    assert got == [(1, 1, 0.0, 0.0, 22.0, 11.0, 0.9, 2), (1, 3, 200.0, 0.0, 10.0, 10.0, 0.1, 1)]


def test_decoding():
    table = {1: [0.1, 0.2, 0.3, 0.9], 3: [0.0, 0.5, 0.9, 0.9], 0: [1, 0, 0, 0]}
    assert signals.greedy_tokens(lambda ids: table.get(ids[-1], [0, 0, 1, 0]), 1, most=5) == [3, 3, 3, 3, 3]
    assert signals.greedy_tokens(lambda ids: [0, 0, 1, 0], 1) == []
    assert signals.beam_tokens(lambda ids: [0.0, 0.0, 5.0, 0.0] if len(ids) > 2 else [0.0, 0.0, 0.0, 5.0], 1) == [3, 3]


def test_images():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (7, 5, 4), dtype=np.uint8)
    assert (images.decode(images.encode_png(a)) == a).all()
    ppm = b"P6\n# c\n5 7\n255\n" + a[:, :, :3].tobytes()
    assert (images.decode(ppm)[:, :, :3] == a[:, :, :3]).all()
    assert images.resize(a, 10, 14).shape == (14, 10, 4) and images.resize_to_fit(a, 3).shape == (3, 2, 4)
    box, scale, x, y = images.letterbox(a, 20)
    assert box.shape == (20, 20, 4) and scale == 1 and (box[y : y + 7, x : x + 5] == a).all() and box[0, 0, 0] == images.FILL
    assert images.crop(a, 3, 3, 100, 100).shape == (4, 2, 4) and images.crop(a, 50, 50, 2, 2).shape == (1, 1, 4)
    assert (images.swap_red_blue(images.swap_red_blue(a)) == a).all() and images.pad_to_stride(a, 4).shape == (8, 8, 4)
    assert images.normalize(a, [0.5] * 3, [0.5] * 3).shape == (3, 7, 5)
    with pytest.raises(ValueError):
        images.array(2, 2, "rgb", b"x")
    p = np.zeros((6, 6))
    p[1:4, 1:4] = 1
    p[5, 5] = 1
    assert images.components(p) == [(1, 1, 3, 3, 9), (5, 5, 1, 1, 1)]
    assert [len(c) for c in images.contours(p)] == [8]


def test_graph():
    g = graph.Graph()
    seen = []
    for name, needs in (("d", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("a", [])):
        g.add(graph.TransformNode(name, lambda c, n=name: seen.append(n)), needs)
    g.run(graph.Context())
    assert seen == g.order() == ["a", "b", "c", "d"] and len(g) == 4
    stopped = graph.Context()
    stopped.cancel()
    for bad in (lambda: g.run(stopped), lambda: graph.topological_order({"x": ("y",)}), lambda: graph.topological_order({"x": ("y",), "y": ("x",)})):
        with pytest.raises(graph.GraphError):
            bad()
    assert graph.read_manifest("name: p\nnodes:\n- name: a\n  type: t\n- name: b\n  depends_on: [a]\n")[1]["depends_on"] == ["a"]
    assert graph.read_manifest('{"name": "p", "nodes": [{"name": "a"}]}')[0]["pipeline"] == "p"


def test_plugins(spark):
    class Add(graph.Plugin):
        name = "add"

        def handle(self, action, frame, metadata):
            return frame.withColumn("n", F.col("id") + metadata["by"])

    r = graph.Registry()
    r.register(Add())
    with pytest.raises(ValueError):
        r.register(Add())
    assert r.handle_all("x", spark.range(2), {"by": 5}).agg(F.sum("n").alias("s")).first().s == 11
    assert r.list() == ["add"] and r.handle_all("x", spark.range(2), names=set()).columns == ["id"]
    r.unregister("add")
    assert not r.has("add")
    bus, got = EventBus(), []
    bus.subscribe("done", got.append)
    bus.emit("done", n=1)
    bus.emit("other")
    assert got == [{"n": 1}]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name": "m", "model_type": "ctc", "extra": 1}')
    config = models.read_configs(spark, str(tmp_path / "c.json")).first()
    assert config["name"] == "m" and config.threshold == 0.25 and config.color == "rgb"
    (tmp_path / "m.json").write_text('{"sourceUrl": "u", "models": {"det": {"variants": [{"id": "a", "url": "x", "sha256": "s"}, {"id": ""}]}}}')
    manifest = models.read_manifest(spark, str(tmp_path / "m.json"))
    assert manifest.count() == 2 and [r.violation for r in models.manifest_violations(manifest).collect()] == ["variant"]
    (tmp_path / "k.txt").write_text("a\nb\r\nc\n")
    (tmp_path / "k.yml").write_text("character_dict:\n- a\n- '#'\n")
    assert [tuple(r) for r in models.read_keys(spark, str(tmp_path / "k.txt")).orderBy("id").collect()] == [(2, "a"), (3, "b"), (4, "c")]
    assert [tuple(r) for r in models.read_keys(spark, str(tmp_path / "k.yml")).orderBy("id").collect()] == [(1, "a"), (2, "#"), (3, " ")]
    (tmp_path / "t.json").write_text('{"model": {"vocab": {"<s>": 0, "x": 7}}}')
    assert {tuple(r) for r in models.read_vocabulary(spark, str(tmp_path / "t.json")).collect()} == {(0, "<s>"), (7, "x")}
    (tmp_path / "i.png").write_bytes(images.encode_png(np.zeros((2, 3, 4), np.uint8)))
    (tmp_path / "j.png").write_bytes(b"no")
    read = {r.path[-5:]: r for r in models.read_images(spark, str(tmp_path) + "/*.png").collect()}
    assert read["i.png"].width == 3 and read["i.png"].error is None and read["j.png"].error
    names = spark.createDataFrame([("ok",), ("../x",), ("a/b",), ("",), (None,)], "n string")
    assert [r.ok for r in names.select(models.safe_name(F.col("n")).alias("ok")).collect()].count(True) == 1


def test_streaming(spark, tmp_path):
    boxes_ = "image_id long, box_id int, x double, y double, w double, h double, confidence double"
    for i in range(3):
        spark.createDataFrame([(i, 1, 0.0, 0.0, 20.0, 20.0, 0.9), (i, 2, 0.0, 0.0, 2.0, 2.0, 0.9)], boxes_).write.mode("append").parquet(f"{tmp_path}/in")
    query = front.run(front.rows_of_files(spark, f"{tmp_path}/in", boxes_, 1), boxes.large_and_sure, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_conversion_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "<math>"), (2, "<math><mi>x</mi></math>"), (3, None)], "id long, t string")
    got = {r.id: r for r in convert.convert_formulas(df, "t", "mathml", ("latex",)).collect()}
    assert got[1].error and got[1].result is None and got[2].result == "$$x$$" and got[3].result is None and got[3].error is None
    with pytest.raises(ValueError):
        convert.convert_formulas(df, "t", "word")


def test_stub_and_cli(capsys, monkeypatch):
    import io

    assert session() is session() and isinstance(session(), StubSession)
    assert session().run({"x": np.ones((1, 2))})["x_output"].sum() == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("x^2"))
    main(["convert", "--target", "typst"])
    assert capsys.readouterr().out == "$ x^(2) $\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("# a"))
    main(["parse", "--language", "markdown"])
    assert json.loads(capsys.readouterr().out)[0]["kind"] == "heading"


@settings(max_examples=200, deadline=None)
@given(st.text("# $\n*ab", max_size=60))
def test_any_markdown_ends(text):
    for kind, level, body, _ in prose.from_markdown(text):
        assert kind in ("heading", "paragraph", "formula") and (kind == "heading") == (level > 0) and isinstance(body, str)


def test_spaces_are_inserted_in_whole_texts(spark):
    from folioframe.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = {r.id: r.text for r in catalogue.queries()["txt_insert_spaces"](spark, sf).collect()}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert max(map(len, texts.values())) > 40 and len(got) == 6 * len(texts)
    assert all("".join(got[i * 10 + 4].split()) == "".join(("plain text" + x).split()) for i, x in texts.items())


def test_every_box_is_recognised(spark):
    from folioframe.fixtures import view
    from folioframe.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()["mock_recognition"](spark, sf)
    assert got.count() == view(spark, sf, "v_boxes").count() == got.select("image_id", "box_id").distinct().count()


def test_visitor():
    from folioframe.document import Block, Builder, Visitor

    class Kinds(Visitor):
        def __init__(self):
            self.seen = []

        def block(self, block):
            self.seen.append(block.kind)

        def inline(self, text):
            self.seen.append(text)

    document = Builder().page().heading(1, "h").quote([Block("paragraph", "p")]).items(["a", "b"]).rule().build()
    assert document.accept(Kinds()).seen == ["heading", "h", "quote", "paragraph", "p", "list", "a", "b", "horizontal_rule"]


def test_chains_of_scripts(spark):
    from pyspark.sql import functions as F

    from folioframe.functions import markup

    cases = {"x^a^b": "{x^a}^b", "x^a^b^c^{d+e}+1": "{{{x^a}^b}^c}^{d+e}+1", "y_1_2 z^^2": "{y_1}_2 z^2", "x^2 y_i": "x^2 y_i", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", markup.split_double_scripts(F.col("t")).alias("s")).collect()} == cases


def test_sql_function(spark):
    from folioframe.operators import convert

    convert.register(spark)
    got = spark.sql("SELECT folioframe_convert('x^2', 'latex', 'typst') AS a, folioframe_convert(CAST(NULL AS STRING), 'latex', 'typst') AS b").first()
    assert "x" in got.a and got.b is None


def test_service_and_render(monkeypatch, capsys):
    import io
    import sys

    from folioframe.__main__ import main
    from folioframe.plans.engine import Service

    class One(Service):
        name = "one"

        def start(self):
            self.begun = True

    with One() as one:
        assert one.running and one.begun
    assert not one.running
    monkeypatch.setattr(sys, "stdin", io.StringIO("so $x$ and $$y$$"))
    assert main(["render"]) == 0
    assert capsys.readouterr().out == "so\n\n$x$\n\nand\n\n$$\ny\n$$\n"
