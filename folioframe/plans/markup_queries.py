"""Queries over formulas' LaTeX, recognised text and documents, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.fixtures import duck_sql, view
from folioframe.functions import markup as m
from folioframe.operators import documents as d
from folioframe.session import table


def _formulas(**columns):
    return lambda sp, sf: view(sp, sf, "v_formulas").select("formula_id", *[f(F.col("latex")).alias(n) for n, f in columns.items()])


_BAL = r"(len(regexp_replace({t}, '\\[\\{}]', '', 'g')) - len(replace(regexp_replace({t}, '\\[\\{}]', '', 'g'), '{', '')) - (len(regexp_replace({t}, '\\[\\{}]', '', 'g')) - len(replace(regexp_replace({t}, '\\[\\{}]', '', 'g'), '}', ''))))"
_LR = r"(len(regexp_extract_all({t}, '\\left(?:[^A-Za-z]|$)')) - len(regexp_extract_all({t}, '\\right(?:[^A-Za-z]|$)')))"
_DUP = r"regexp_matches({t}, '(^|[^\\])==')"
_ENV = r"""(len(list_reduce(list_concat([['']], list_transform(regexp_extract_all({t}, '\\(?:begin|end)\{[^}]*\}'), lambda k: [k])), lambda st, k:
  CASE WHEN starts_with(k[1], '\begin') THEN list_append(st, regexp_extract(k[1], '\{([^}]*)\}', 1)) WHEN len(st) > 1 AND st[-1] = regexp_extract(k[1], '\{([^}]*)\}', 1) THEN st[:-2] ELSE list_append(st, '!') END)) = 1)"""
_RUN = r"""(list_max(list_concat([0], list_transform(range(1, len(tk) - 6), lambda i: CASE WHEN len(list_distinct(tk[i:i + 7])) = 1 THEN 1 ELSE 0 END))) = 1)"""
_TOK = r"(SELECT *, regexp_extract_all(trim(latex), '\\[A-Za-z]+|[\p{L}\p{N}]+|[^\s]') AS tk FROM {v_formulas} f)"


def _at(expr: str, t: str = "latex") -> str:
    return expr.replace("{t}", t)


_FLAGS = f"list_filter([CASE WHEN {_at(_DUP, 'trim(latex)')} THEN 'duplicate_relation' END, CASE WHEN {_RUN} THEN 'repeated_token_run' END, CASE WHEN {_at(_BAL, 'trim(latex)')} <> 0 THEN 'unbalanced_group' END, CASE WHEN NOT {_at(_ENV, 'trim(latex)')} THEN 'mismatched_environment' END, CASE WHEN {_at(_LR, 'trim(latex)')} <> 0 THEN 'unbalanced_left_right' END], lambda z: z IS NOT NULL)"
_F = "FROM {v_formulas} f"


_NL = "chr(10)"
_LINES = "string_split(text, chr(10))"
_B = f"(SELECT *, {_LINES} AS ls, list_transform({_LINES}, lambda r: string_split(r, chr(9))) AS rs, list_max(list_transform({_LINES}, lambda r: len(string_split(r, chr(9))))) AS wide, CASE WHEN ordered THEN 'enumerate' ELSE 'itemize' END AS env FROM {{v_blocks}} b)"
_X = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_XL = f"string_split({_X}, chr(10))"
_XR = f"list_transform({_XL}, lambda r: string_split(r, chr(9)))"
_FENCE = f"'```' || coalesce(language, '') || {_NL} || text || {_NL} || '```'"


def _each(lines: str, before: str, after: str = "", between: str = _NL) -> str:
    return f"array_to_string(list_transform({lines}, lambda z: '{before}' || z || '{after}'), {between})"


_MARKDOWN = f"""CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'paragraph' THEN text WHEN 'formula' THEN '$$' || text || '$$'
 WHEN 'list' THEN CASE WHEN ordered THEN array_to_string(list_transform(ls, lambda z, i: i || '. ' || z), {_NL}) ELSE {_each('ls', '- ')} END WHEN 'quote' THEN {_each('ls', '> ')} WHEN 'code' THEN {_FENCE}
 WHEN 'table' THEN '| ' || array_to_string(rs[1], ' | ') || ' |' || {_NL} || '|' || repeat(' --- |', wide) || CASE WHEN len(rs) > 1 THEN {_NL} || array_to_string(list_transform(rs[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), {_NL}) ELSE '' END
 WHEN 'figure' THEN '![' || text || ']()' ELSE '---' END"""


def _printed(case: str, between: str = "chr(10) || chr(10)", head: str = "''", foot: str = "''") -> str:
    return f"SELECT doc_id, {head} || string_agg({case}, {between} ORDER BY page_idx, ord) || {foot} AS body FROM {_B} z GROUP BY doc_id"


def _latex_case(a: str, z: str) -> str:
    return f"""CASE kind WHEN 'heading' THEN '\\' || (['section', 'subsection', 'subsubsection', 'paragraph', 'subparagraph', 'section'])[level] || '{{' || text || '}}' WHEN 'paragraph' THEN text WHEN 'formula' THEN {a} || text || {z}
    WHEN 'list' THEN '\\begin{{' || env || '}}' || chr(10) || {_each('ls', chr(92) + 'item ')} || chr(10) || '\\end{{' || env || '}}' WHEN 'quote' THEN '\\begin{{quote}}' || chr(10) || text || chr(10) || '\\end{{quote}}'
    WHEN 'code' THEN CASE WHEN language IS NULL THEN '\\begin{{verbatim}}' || chr(10) || text || chr(10) || '\\end{{verbatim}}' ELSE '\\begin{{lstlisting}}[language=' || language || ']' || chr(10) || text || chr(10) || '\\end{{lstlisting}}' END
    WHEN 'table' THEN '\\begin{{tabular}}{{|' || repeat('c|', wide) || '}}' || chr(10) || array_to_string(list_transform(rs, lambda r: array_to_string(r, ' & ') || ' \\\\'), chr(10)) || chr(10) || '\\end{{tabular}}'
    WHEN 'figure' THEN CASE WHEN text <> '' THEN '\\begin{{figure}}' || chr(10) || '\\caption{{' || text || '}}' || chr(10) || '\\end{{figure}}' END ELSE '\\hrule' END"""


_CELLS = "array_to_string(list_transform({r}, lambda c: '<{t}>' || c || '</{t}>'), '')"
_HTML = f"""CASE kind WHEN 'heading' THEN '<h' || level || '>' || {_X} || '</h' || level || '>' WHEN 'paragraph' THEN '<p>' || {_X} || '</p>' WHEN 'formula' THEN '\\[' || text || '\\]'
 WHEN 'list' THEN CASE WHEN ordered THEN '<ol>' ELSE '<ul>' END || {_each(_XL, '<li>', '</li>', "''")} || CASE WHEN ordered THEN '</ol>' ELSE '</ul>' END WHEN 'quote' THEN '<blockquote>' || {_each(_XL, '<p>', '</p>', "''")} || '</blockquote>'
 WHEN 'code' THEN '<pre><code' || coalesce(' class="language-' || language || '"', '') || '>' || {_X} || '</code></pre>'
 WHEN 'table' THEN '<table><thead><tr>' || {_CELLS.format(r=f'({_XR})[1]', t='th')} || '</tr></thead>' || CASE WHEN len(rs) > 1 THEN '<tbody>' || array_to_string(list_transform(({_XR})[2:], lambda r: '<tr>' || {_CELLS.format(r='r', t='td')} || '</tr>'), '') || '</tbody>' ELSE '' END || '</table>'
 WHEN 'figure' THEN '<figure><figcaption>' || {_X} || '</figcaption></figure>' ELSE '<hr>' END"""
_HTML_HEAD = """'<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><script src="https://cdn.jsdelivr.net/npm/mathjax@3/es5/tex-mml-chtml.js"></script></head><body>' || chr(10)"""
_TYPST = f"""CASE kind WHEN 'heading' THEN repeat('=', level) || ' ' || text WHEN 'paragraph' THEN text WHEN 'formula' THEN '$ ' || text || ' $' WHEN 'list' THEN CASE WHEN ordered THEN {_each('ls', '+ ')} ELSE {_each('ls', '- ')} END WHEN 'quote' THEN '#quote[' || text || ']'
 WHEN 'code' THEN {_FENCE} WHEN 'table' THEN '#table(columns: ' || wide || ', ' || array_to_string(list_transform(flatten(rs), lambda z: '[' || z || ']'), ', ') || ')' WHEN 'figure' THEN '// ' || text ELSE '#line(length: 100%)' END"""
_SVG = f"""SELECT doc_id, '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="200">' || chr(10) || string_agg('<text x="10" y="' || y || '">' || replace({_X}, chr(39), '&apos;') || '</text>', chr(10) ORDER BY page_idx, ord) || chr(10) || '</svg>' || chr(10) AS body
 FROM (SELECT *, CAST(20 + coalesce(sum(CASE WHEN kind = 'formula' THEN 25 ELSE 20 END) OVER (PARTITION BY doc_id, page_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM {{v_blocks}} b WHERE kind IN ('paragraph', 'formula')) q GROUP BY doc_id"""


def _syntax_sql(a: str, z: str, formula: str = "text") -> str:
    return f"SELECT doc_id, string_agg(CASE WHEN kind = 'formula' THEN {a} || {formula} || {z} WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY page_idx, ord) AS body FROM {{v_blocks}} b WHERE kind IN ('paragraph', 'formula') GROUP BY doc_id HAVING body IS NOT NULL"


def _replaced_sql() -> str:
    out = "text"
    for old, new in d.REPLACED:
        out = f"replace({out}, '{old}', '{new}')"
    return f"replace({out}, chr(92), '')"


def _blocks(f, *a, **k):
    return lambda sp, sf: f(view(sp, sf, "v_blocks"), *a, **k)


def _digest(f, *a, **k):
    """Whole bodies are compared by length and SHA-256."""
    return lambda sp, sf: f(view(sp, sf, "v_blocks"), *a, **k).select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("digest"))


def _digested(sql: str) -> str:
    return f"SELECT doc_id, length(body) AS n_chars, sha256(body) AS digest FROM ({sql}) q"


def _spaces(sp, sf):
    return view(sp, sf, "v_mixed").select("id", m.insert_spaces(F.col("text")).alias("text"))


def _spaced_sql() -> str:
    """A space after each character where the next two ask for one; written by places, as SQL has no look-around."""
    at = lambda k: f"substr(text, i + {k}, 1)"
    latin = lambda x: f"regexp_full_match({x}, '[A-Za-z0-9]')"
    han = lambda x: f"({x} <> '' AND (unicode({x}) BETWEEN 11904 AND 40959 OR unicode({x}) BETWEEN 44032 AND 55215 OR unicode({x}) BETWEEN 63744 AND 64255))"
    stop, here, next_ = "contains('.,;:!?', " + at(0) + ")", at(0), at(1)
    after_stop = f"{stop} AND (({latin(next_)} AND {at(2)} NOT IN ('.', ',')) OR {han(next_)})"
    after_latin = f"{latin(here)} AND ({han(next_)} OR {next_} IN ('(', ')', '[', ']'))"
    space = f"({after_stop}) OR ({after_latin}) OR ({han(here)} AND {latin(next_)})"
    return f"SELECT id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: {here} || CASE WHEN {space} THEN ' ' ELSE '' END), '') AS text FROM {{v_mixed}} m"


def _edits(blocks):
    """An edit of every block, its type by place."""
    return blocks.select("doc_id", F.col("ord").alias("seq"), F.when(F.col("ord") % 2 == 0, "insert_block").otherwise("replace_text").alias("type"), "page_idx", "ord")


QUERIES = {
    "qc_dup_relation": (_formulas(dup=m.duplicate_relation), f"SELECT formula_id, {_at(_DUP)} AS dup {_F}"),
    "qc_balance": (_formulas(balance=lambda t: m.group_balance(t).cast("long")), f"SELECT formula_id, {_at(_BAL)} AS balance {_F}"),
    "qc_left_right": (_formulas(balance=lambda t: m.left_right_balance(t).cast("long")), f"SELECT formula_id, {_at(_LR)} AS balance {_F}"),
    "qc_env": (_formulas(ok=m.environments_balanced), f"SELECT formula_id, {_at(_ENV)} AS ok {_F}"),
    "qc_run": (_formulas(run=m.repeated_token_run), f"SELECT formula_id, {_RUN} AS run FROM {_TOK} z"),
    "qc_flags": (_formulas(flags=lambda t: F.array_join(m.quality_flags(t), ",")), f"SELECT formula_id, array_to_string({_FLAGS}, ',') AS flags FROM {_TOK} z"),
    "qc_severe": (_formulas(severe=lambda t: m.severe(m.quality_flags(t))), f"SELECT formula_id, len(list_filter({_FLAGS}, lambda q: q <> 'unbalanced_left_right')) > 0 AS severe FROM {_TOK} z"),
    "rep_close_groups": (_formulas(fixed=m.close_groups), f"SELECT formula_id, latex || repeat('}}', CAST(greatest({_at(_BAL)}, 0) AS BIGINT)) AS fixed {_F}"),
    "rep_left_right": (_formulas(fixed=m.drop_unbalanced_delimiters), rf"SELECT formula_id, CASE WHEN {_at(_LR)} <> 0 THEN regexp_replace(latex, '\\(?:left|right)([^A-Za-z]|$)', '\1', 'g') ELSE latex END AS fixed {_F}"),
    "rep_amp": (_formulas(fixed=m.space_alignment), rf"SELECT formula_id, CASE WHEN contains(latex, '\begin{{') THEN latex ELSE regexp_replace(latex, '(^|[^\\])&', '\1\\quad ', 'g') END AS fixed {_F}"),
    "rep_wrap": (_formulas(fixed=m.delimit), f"SELECT formula_id, CASE WHEN starts_with(latex, '$') THEN latex ELSE '$$ ' || latex || ' $$' END AS fixed {_F}"),
    "rep_all": (_formulas(fixed=m.repair), None),
    "rep_all_compat": (_formulas(fixed=lambda t: m.repair(t, compat=True)), None),
    "txt_insert_spaces": (_spaces, _spaced_sql()),
    "doc_block_count": (_blocks(d.block_counts), "SELECT doc_id, count(*) AS n_blocks FROM {v_blocks} b GROUP BY doc_id"),
    "doc_type_hist": (_blocks(d.type_histogram), "SELECT kind, count(*) AS n FROM {v_blocks} b GROUP BY kind"),
    "doc_get_block": (_blocks(d.block_at, 0, 3), "SELECT * FROM {v_blocks} b WHERE page_idx = 0 AND ord = 3"),
    "doc_node_ids": (_blocks(d.node_ids), "SELECT doc_id, page_idx, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, ord) - 1 AS node, '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, ord) - 1) AS shown FROM {v_blocks} b"),
    "doc_spans": (
        _blocks(d.spans),
        'SELECT doc_id, page_idx, ord, CAST(e - l AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", l AS len, CAST(w AS BIGINT) AS merged_end FROM (SELECT *, strlen(text) AS l, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_idx, ord) - 1 AS e, sum(strlen(text) + 1) OVER (PARTITION BY doc_id) - 1 AS w FROM {v_blocks} b) z',
    ),
    "doc_text_collect": (_digest(d.collect_text), _digested("SELECT doc_id, string_agg(CASE WHEN kind = 'horizontal_rule' THEN '---' || chr(10) WHEN kind NOT IN ('table', 'figure') THEN text || chr(10) END, '' ORDER BY page_idx, ord) AS body FROM {v_blocks} b GROUP BY doc_id")),
    "doc_json_roundtrip": (lambda sp, sf: d.from_json(d.to_json(view(sp, sf, "v_blocks"))), "SELECT * FROM {v_blocks} b"),
    "doc_operation_inverse": (lambda sp, sf: d.inverse_edits(_edits(view(sp, sf, "v_blocks"))), "SELECT doc_id, ord AS seq, CASE WHEN ord % 2 = 0 THEN 'remove_block' END AS inverse, page_idx, ord FROM {v_blocks} b"),
    "conv_latex": (_digest(d.latex), _digested(_printed(_latex_case("'$$'", "'$$'"), head=r"'\documentclass{article}' || chr(10) || '\usepackage{amsmath}' || chr(10) || '\usepackage{listings}' || chr(10) || '\begin{document}' || chr(10) || chr(10)", foot=r"chr(10) || chr(10) || '\end{document}' || chr(10)"))),
    "conv_latex_display": (_digest(d.latex_display), _digested(_printed(_latex_case(r"'\['", r"'\]'")))),
    "conv_latex_equation": (_digest(d.latex_equation), _digested(_printed(_latex_case(r"'\begin{equation}' || chr(10)", r"chr(10) || '\end{equation}'")))),
    "conv_markdown_block": (_digest(d.markdown), _digested(_printed(_MARKDOWN))),
    "conv_typst": (_digest(d.typst), _digested(_printed(_TYPST))),
    "conv_html": (_digest(d.html, page=False), _digested(_printed(_HTML, "chr(10)"))),
    "conv_html_page": (_digest(d.html), _digested(_printed(_HTML, "chr(10)", head=_HTML_HEAD, foot="chr(10) || '</body></html>' || chr(10)"))),
    "conv_typst_document": (_digest(d.typst_document), None),
    "conv_mathml_document": (_digest(d.mathml), None),
    "conv_omml_document": (_digest(d.omml), None),
    "syntax_latex": (_digest(d.syntax, "latex"), _digested(_syntax_sql("'$$' || chr(10)", "chr(10) || '$$'"))),
    "syntax_typst": (_digest(d.syntax, "typst"), _digested(_syntax_sql("'$ '", "' $'", _replaced_sql()))),
    "syntax_typst_formulas": (_formulas(typst=d.typst_replaced), f"SELECT formula_id, {_replaced_sql().replace('text', 'latex', 1)} AS typst {_F}"),
    "render_counts": (_blocks(d.render_counts), "SELECT doc_id, count(DISTINCT page_idx) AS pages, count(*) FILTER (WHERE kind IN ('paragraph', 'formula')) AS nodes FROM {v_blocks} b GROUP BY doc_id"),
    "conv_xml_escape": (lambda sp, sf: table(sp, sf, "documents").select("doc_id", F.sha2(m.xml_escape(F.col("text")), 256).alias("escaped")), f"SELECT doc_id, sha256({_X}) AS escaped FROM documents"),
    "render_tree": (_blocks(d.render_nodes), "SELECT doc_id, page_idx, ord, kind, text FROM {v_blocks} b WHERE kind IN ('paragraph', 'formula')"),
    "render_text": (_digest(d.render_text), _digested("SELECT doc_id, string_agg(text, chr(10) ORDER BY page_idx, ord) AS body FROM {v_blocks} b WHERE kind IN ('paragraph', 'formula') GROUP BY doc_id")),
    "render_svg_layout": (
        lambda sp, sf: d.svg_layout(view(sp, sf, "v_blocks")).select("doc_id", "ord", F.col("y").cast("long").alias("y")),
        "SELECT doc_id, ord, CAST(20 + coalesce(sum(CASE WHEN kind = 'formula' THEN 25 ELSE 20 END) OVER (PARTITION BY doc_id, page_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM {v_blocks} b WHERE kind IN ('paragraph', 'formula')",
    ),
    "render_svg": (_blocks(d.svg), _SVG),
    "render_pdf": (_blocks(d.pdf), None),
}
SQL = {name: duck_sql(sql) for name, (_, sql) in QUERIES.items() if sql}
