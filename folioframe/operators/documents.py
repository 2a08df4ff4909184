"""Documents as rows of blocks: traversal, text collection, printing in a dozen formats, and layout trees.

A block is a row (doc_id, page_idx, ord, kind, level, text), with language and ordered where there are any. The text of a
list has a line an item, that of a table a line a row and a tab between cells (the first row is the head), that of a quote
a line a block. A formula block's text is LaTeX; a paragraph may hold formulas between dollar signs. A document is printed
by one shuffle: blocks are printed where they are and joined in order by (page_idx, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.markup import xml_escape

KINDS = ("heading", "paragraph", "formula", "table", "figure", "list", "quote", "code", "horizontal_rule")


def joined(blocks: DataFrame, printed: Column, between: str = "\n\n", out: str = "body") -> DataFrame:
    """(doc_id, body): the printed blocks of each document in order; null prints are left out."""
    rows = blocks.select("doc_id", "page_idx", "ord", printed.alias("p")).where("p IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("page_idx", "ord", "p")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x.p), between).alias(out))


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def block_at(blocks: DataFrame, page: int, place: int) -> DataFrame:
    return blocks.where((F.col("page_idx") == page) & (F.col("ord") == place))


def node_ids(blocks: DataFrame) -> DataFrame:
    """Numbers from 0 in document order, printed as #n."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "ord")) - 1
    return blocks.select("doc_id", "page_idx", "ord", n.alias("node"), F.concat(F.lit("#"), n.cast("string")).alias("shown"))


def spans(blocks: DataFrame) -> DataFrame:
    """Byte offsets of each block in its document's text, lines joined by one byte; and the span that covers the document."""
    order = Window.partitionBy("doc_id").orderBy("page_idx", "ord")
    size = F.octet_length("text").cast("long")
    end = F.sum(size + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    whole = F.sum(size + 1).over(Window.partitionBy("doc_id")) - 1
    return blocks.select("doc_id", "page_idx", "ord", (end - size).alias("start"), end.alias("end"), size.alias("len"), whole.alias("merged_end"))


def collect_text(blocks: DataFrame) -> DataFrame:
    """Text of a document: a line a block, rules as ---; tables and figures have none."""
    text = F.when(F.col("kind") == "horizontal_rule", F.lit("---\n")).when(~F.col("kind").isin("table", "figure"), F.concat("text", F.lit("\n")))
    return joined(blocks, text, "")


def as_latex(blocks: DataFrame) -> DataFrame:
    """Formula blocks with `latex`: their text where their format is latex (or there is none), else an empty text."""
    other = F.coalesce(F.lower(_own(blocks, "format", "string")) != "latex", F.lit(False))
    return blocks.where("kind = 'formula'").withColumn("latex", F.when(other, "").otherwise(F.coalesce("text", F.lit(""))))


def places(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, ord, x, y, w, h, confidence, source): where each block comes from; null where that is unknown."""
    numbers = [_own(blocks, c, "double").alias(c) for c in ("x", "y", "w", "h", "confidence")]
    return blocks.select("doc_id", "page_idx", "ord", *numbers, _own(blocks, "source", "string").alias("source"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _rows(text: Column) -> Column:
    return F.transform(_lines(text), lambda r: F.split(r, "\t"))


def _columns(text: Column) -> Column:
    """Cells of a table's longest row."""
    return F.array_max(F.transform(_rows(text), lambda r: F.size(r)))


def _each(text: Column, before: str, after: str = "", between: str = "\n") -> Column:
    """The lines of a text, each between two strings."""
    return F.array_join(F.transform(_lines(text), lambda x: F.concat(F.lit(before), x, F.lit(after))), between)


def _numbered(text: Column) -> Column:
    return F.array_join(F.transform(_lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _own(blocks: DataFrame, name: str, kind: str) -> Column:
    """An optional column of blocks, or null."""
    return F.col(name) if name in blocks.columns else F.lit(None).cast(kind)


def _by_kind(**prints: Column) -> Column:
    shown = F.lit(None).cast("string")
    for kind, p in prints.items():
        shown = F.when(F.col("kind") == kind, p).otherwise(shown)
    return shown


def _fenced(blocks: DataFrame) -> Column:
    return F.concat(F.lit("```"), F.coalesce(_own(blocks, "language", "string"), F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```"))


def _ordered(blocks: DataFrame) -> Column:
    return F.coalesce(_own(blocks, "ordered", "boolean"), F.lit(False))


def markdown(blocks: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = F.transform(_rows(text), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), _columns(text)))
    printed = _by_kind(
        heading=F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text),
        paragraph=text,
        formula=F.concat(F.lit("$$"), text, F.lit("$$")),
        list=F.when(_ordered(blocks), _numbered(text)).otherwise(_each(text, "- ")),
        quote=_each(text, "> "),
        code=_fenced(blocks),
        table=F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n"),
        figure=F.concat(F.lit("!["), text, F.lit("]()")),
        horizontal_rule=F.lit("---"),
    )
    return joined(blocks, printed)


_SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "section")


def latex(blocks: DataFrame, formula: tuple[str, str] = ("$$", "$$"), preamble: bool = True) -> DataFrame:
    text, language = F.col("text"), _own(blocks, "language", "string")
    section = F.element_at(F.array(*[F.lit(x) for x in _SECTIONS]), F.col("level"))
    listed = F.when(_ordered(blocks), "enumerate").otherwise("itemize")
    rows = F.array_join(F.transform(_rows(text), lambda r: F.concat(F.array_join(r, " & "), F.lit(" \\\\"))), "\n")
    verbatim = F.concat(F.lit("\\begin{verbatim}\n"), text, F.lit("\n\\end{verbatim}"))
    listing = F.concat(F.lit("\\begin{lstlisting}[language="), language, F.lit("]\n"), text, F.lit("\n\\end{lstlisting}"))
    printed = _by_kind(
        heading=F.concat(F.lit("\\"), section, F.lit("{"), text, F.lit("}")),
        paragraph=text,
        formula=F.concat(F.lit(formula[0]), text, F.lit(formula[1])),
        list=F.concat(F.lit("\\begin{"), listed, F.lit("}\n"), _each(text, "\\item "), F.lit("\n\\end{"), listed, F.lit("}")),
        quote=F.concat(F.lit("\\begin{quote}\n"), text, F.lit("\n\\end{quote}")),
        code=F.when(language.isNull(), verbatim).otherwise(listing),
        table=F.concat(F.lit("\\begin{tabular}{|"), F.repeat(F.lit("c|"), _columns(text)), F.lit("}\n"), rows, F.lit("\n\\end{tabular}")),
        figure=F.when(text != "", F.concat(F.lit("\\begin{figure}\n\\caption{"), text, F.lit("}\n\\end{figure}"))),
        horizontal_rule=F.lit("\\hrule"),
    )
    made = joined(blocks, printed)
    if not preamble:
        return made
    head, foot = "\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{listings}\n\\begin{document}\n\n", "\n\n\\end{document}\n"
    return made.withColumn("body", F.concat(F.lit(head), F.col("body"), F.lit(foot)))


def latex_display(blocks: DataFrame) -> DataFrame:
    return latex(blocks, ("\\[", "\\]"), preamble=False)


def latex_equation(blocks: DataFrame) -> DataFrame:
    return latex(blocks, ("\\begin{equation}\n", "\n\\end{equation}"), preamble=False)


def with_math(blocks: DataFrame, target: str) -> DataFrame:
    """blocks whose formulas, and those in paragraphs' dollar signs, are in another format; what cannot be read stays as it is."""
    import pyarrow as pa

    from folioframe.functions import formulas, prose

    at, kinds = blocks.columns.index("text"), blocks.columns.index("kind")

    def run(batches):
        for batch in batches:
            done = {}
            for k, t in set(zip(batch.column(kinds).to_pylist(), batch.column(at).to_pylist(), strict=True)):
                if t is not None and k in ("formula", "paragraph"):
                    done[k, t] = formulas.try_convert(t, target, True) if k == "formula" else prose.with_inlines(t, lambda x, d: formulas.try_convert(x, target, d))
            texts = [done.get((k, t), t) for k, t in zip(batch.column(kinds).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return blocks.mapInArrow(run, blocks.schema)


def typst_document(blocks: DataFrame) -> DataFrame:
    """Typst text of blocks whose formulas are LaTeX."""
    return typst(with_math(blocks, "typst_bare"))


def typst(blocks: DataFrame) -> DataFrame:
    """Typst text of blocks whose formulas are Typst already (see typst_document)."""
    text = F.col("text")
    cells = F.transform(F.flatten(_rows(text)), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    printed = _by_kind(
        heading=F.concat(F.repeat(F.lit("="), F.col("level")), F.lit(" "), text),
        paragraph=text,
        formula=F.concat(F.lit("$ "), text, F.lit(" $")),
        list=F.when(_ordered(blocks), _each(text, "+ ")).otherwise(_each(text, "- ")),
        quote=F.concat(F.lit("#quote["), text, F.lit("]")),
        code=_fenced(blocks),
        table=F.concat(F.lit("#table(columns: "), _columns(text).cast("string"), F.lit(", "), F.array_join(cells, ", "), F.lit(")")),
        figure=F.concat(F.lit("// "), text),
        horizontal_rule=F.lit("#line(length: 100%)"),
    )
    return joined(blocks, printed)


def _math_markup(blocks: DataFrame, target: str, head: str, foot: str) -> DataFrame:
    """Formulas and paragraphs as one XML text; other blocks have no place in it."""
    import pyarrow as pa

    from folioframe.functions import formulas, prose

    kept = blocks.where(F.col("kind").isin("formula", "paragraph")).select("doc_id", "page_idx", "ord", "kind", "text")

    def run(batches):
        for batch in batches:
            made = []
            for kind, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                parts = [(text or "", True)] if kind == "formula" else None
                made.append("\n".join(formulas.markup(x, target, d) for x, d in parts) if parts else "\n".join(formulas.markup(x, target, d) for x, d in prose.inlines(text or "")))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(made, pa.string())], ["doc_id", "page_idx", "ord", "kind", "text"])

    made = joined(kept.mapInArrow(run, kept.schema), F.col("text"), "\n")
    return made.withColumn("body", F.concat(F.lit(head), F.col("body"), F.lit(foot)))


def mathml(blocks: DataFrame, style: str = "plain") -> DataFrame:
    """One math element a document; style as in formulas.to_mathml."""
    p = {"mml": "mml:", "m": "m:"}.get(style, "")
    named = f"xmlns:{p[:-1]}" if p else "xmlns"
    inline = ' mathmode="inline"' if style == "attr" else ""
    return _math_markup(blocks, "mathml_" + style, f'<{p}math{inline} {named}="http://www.w3.org/1998/Math/MathML">\n', f"\n</{p}math>")


def omml(blocks: DataFrame) -> DataFrame:
    """Formulas as OMML and paragraphs as runs of text, for a word processor's body."""
    return _math_markup(blocks, "omml", "", "")


def syntax(blocks: DataFrame, target: str = "latex") -> DataFrame:
    """Formulas and paragraphs alone, in latex, markdown or typst; empty paragraphs are left out."""
    if target not in ("latex", "markdown", "typst"):
        raise ValueError(f"unknown format: {target}")
    kept = blocks.where(F.col("kind").isin("formula", "paragraph"))
    text = F.col("text")
    if target == "typst":
        kept = kept.withColumn("text", F.when(F.col("kind") == "formula", typst_replaced(text)).otherwise(text))
    marks = ("$ ", " $") if target == "typst" else ("$$\n", "\n$$")
    return joined(kept, _by_kind(formula=F.concat(F.lit(marks[0]), text, F.lit(marks[1])), paragraph=F.when(text != "", text)))


#: What the plain replacement puts for LaTeX, in the order in which it does.
REPLACED = (
    ("\\frac{", "("), ("}{", ")/("), ("\\sqrt{", "sqrt("), ("\\int", "integral"), ("\\sum", "sum"), ("\\prod", "product"), ("\\infty", "infinity"), ("\\pi", "pi"),
    ("\\alpha", "alpha"), ("\\beta", "beta"), ("\\gamma", "gamma"), ("\\delta", "delta"), ("\\theta", "theta"), ("\\lambda", "lambda"), ("\\sigma", "sigma"), ("\\omega", "omega"),
    ("\\pm", "plus.minus"), ("\\times", "times"), ("\\div", "div"), ("\\cdot", "dot"), ("\\leq", "lt.eq"), ("\\geq", "gt.eq"), ("\\neq", "neq"), ("\\approx", "approx"),
    ("\\rightarrow", "rightarrow"), ("\\leftarrow", "leftarrow"), ("\\in", "in"), ("\\notin", "notin"), ("\\subset", "subset"), ("\\cup", "union"), ("\\cap", "intersect"),
)


def typst_replaced(text: Column) -> Column:
    """LaTeX with its commands replaced one after another and other backslashes taken out: quick, and not always Typst."""
    out = text
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.replace(out, F.lit("\\"), F.lit(""))


MATHJAX = "https://cdn.jsdelivr.net/npm/mathjax@3/es5/tex-mml-chtml.js"


def html(blocks: DataFrame, page: bool = True, script: str = MATHJAX) -> DataFrame:
    """script: where a page loads the formula renderer from."""
    t, language = xml_escape(F.col("text")), xml_escape(_own(blocks, "language", "string"))
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    level = F.col("level").cast("string")
    row = lambda cell: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: tag(cell, c)), ""), F.lit("</tr>"))
    rows = _rows(t)
    rest = F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), row("td")), "")
    body = F.when(F.size(rows) > 1, tag("tbody", rest)).otherwise(F.lit(""))
    printed = _by_kind(
        heading=F.concat(F.lit("<h"), level, F.lit(">"), t, F.lit("</h"), level, F.lit(">")),
        paragraph=tag("p", t),
        formula=F.concat(F.lit("\\["), F.col("text"), F.lit("\\]")),
        list=F.when(_ordered(blocks), tag("ol", _each(t, "<li>", "</li>", ""))).otherwise(tag("ul", _each(t, "<li>", "</li>", ""))),
        quote=tag("blockquote", _each(t, "<p>", "</p>", "")),
        code=F.concat(F.lit("<pre><code"), F.coalesce(F.concat(F.lit(' class="language-'), language, F.lit('"')), F.lit("")), F.lit(">"), t, F.lit("</code></pre>")),
        table=tag("table", F.concat(tag("thead", F.array_join(F.transform(F.slice(rows, 1, 1), row("th")), "")), body)),
        figure=tag("figure", tag("figcaption", t)),
        horizontal_rule=F.lit("<hr>"),
    )
    made = joined(blocks, printed, "\n")
    if not page:
        return made
    head = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><script src="{script}"></script></head><body>\n'
    return made.withColumn("body", F.concat(F.lit(head), F.col("body"), F.lit("\n</body></html>\n")))


def render_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, pages, nodes) of the render trees; a document's pages count though none of their blocks is kept."""
    return blocks.groupBy("doc_id").agg(F.count_distinct("page_idx").alias("pages"), F.count_if(F.col("kind").isin("paragraph", "formula")).alias("nodes"))


def render_nodes(blocks: DataFrame) -> DataFrame:
    """The render tree keeps paragraphs and formulas."""
    return blocks.where(F.col("kind").isin("paragraph", "formula")).select("doc_id", "page_idx", "ord", "kind", "text")


def render_text(blocks: DataFrame) -> DataFrame:
    return joined(render_nodes(blocks), F.col("text"), "\n")


def svg_layout(blocks: DataFrame, top: int = 20, text_step: int = 20, formula_step: int = 25) -> DataFrame:
    """The height of each node on its page: it starts at the top and grows by the steps of the nodes before."""
    before = Window.partitionBy("doc_id", "page_idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "formula", formula_step).otherwise(text_step)
    y = F.lit(top) + F.coalesce(F.sum(step).over(before), F.lit(0))
    return render_nodes(blocks).withColumn("y", y)


def svg(blocks: DataFrame, width: int = 400, height: int = 200) -> DataFrame:
    line = F.concat(F.lit('<text x="10" y="'), F.col("y").cast("string"), F.lit('">'), xml_escape(F.col("text"), apostrophe=True), F.lit("</text>"))
    made = joined(svg_layout(blocks), line, "\n")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">\n'
    return made.withColumn("body", F.concat(F.lit(head), F.col("body"), F.lit("\n</svg>\n")))


def pdf_bytes(lines: list[str]) -> bytes:
    """A one-page PDF of text lines in Helvetica 12, with the byte offsets that its table needs."""
    clean = [x.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines]
    stream = b"BT /F1 12 Tf 50 750 Td 14 TL\n" + b"\n".join(b"(" + x + b") Tj T*" for x in clean) + b"\nET"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = len(out)
    out += b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table
    return bytes(out)


def pdf(blocks: DataFrame) -> DataFrame:
    """(doc_id, pdf binary)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [pdf_bytes((t or "").split("\n")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "pdf"])

    return render_text(blocks).mapInArrow(run, "doc_id long, pdf binary")


_JSON = "struct<blocks:array<struct<type:string,level:int,text:string,language:string,ordered:boolean,page_idx:int,ord:int>>>"


def to_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, json) with the blocks as tagged objects in order."""
    optional = [_own(blocks, "language", "string").alias("language"), _own(blocks, "ordered", "boolean").alias("ordered")]
    block = F.struct(F.col("kind").alias("type"), "level", "text", *optional, "page_idx", "ord")
    listed = F.array_sort(F.collect_list(F.struct("page_idx", "ord", block.alias("b"))))
    return blocks.groupBy("doc_id").agg(F.to_json(F.struct(F.transform(listed, lambda x: x.b).alias("blocks"))).alias("json"))


def from_json(documents: DataFrame) -> DataFrame:
    """The blocks of to_json's documents."""
    each = documents.select("doc_id", F.explode(F.from_json("json", _JSON)["blocks"]).alias("b"))
    return each.select("doc_id", "b.page_idx", "b.ord", F.col("b.type").alias("kind"), "b.level", "b.text", "b.language", "b.ordered")


def inverse_edits(edits: DataFrame) -> DataFrame:
    """What undoes each edit: inserting a block is undone by removing it; the others carry no way back."""
    return edits.select("doc_id", "seq", F.when(F.col("type") == "insert_block", F.lit("remove_block")).alias("inverse"), "page_idx", "ord")


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks after edits (doc_id, seq, type, page_idx, ord, text); the last edit of a place counts. An extension."""
    last = edits.groupBy("doc_id", "page_idx", "ord").agg(F.max_by(F.struct("type", F.col("text").alias("new")), "seq").alias("e"))
    both = blocks.join(last, ["doc_id", "page_idx", "ord"], "left")
    changed = F.when(F.col("e.type").isin("replace_text", "replace_formula"), F.col("e.new")).otherwise(F.col("text"))
    return both.where("e IS NULL OR e.type <> 'remove_block'").withColumn("text", changed).drop("e")
