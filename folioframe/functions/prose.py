"""Markdown and LaTeX documents as lists of blocks. Plain Python, no Spark."""

from __future__ import annotations

import re

_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_MATH = re.compile(r"\$\$(.+?)\$\$|\$([^$\n]+?)\$", re.S)


def _pieces(text: str) -> list[tuple[str, str, bool]]:
    """Text and formulas in order: (kind, content, display)."""
    out, at = [], 0
    for m in _MATH.finditer(text):
        if m.start() > at:
            out.append(("text", text[at : m.start()], False))
        out.append(("formula", (m[1] if m[1] is not None else m[2]).strip(), m[1] is not None))
        at = m.end()
    if at < len(text):
        out.append(("text", text[at:], False))
    return out


def _paragraph(text: str) -> list[tuple[str, int, str, bool]]:
    """A paragraph's text between display formulas, which are blocks; inline formulas stay in it."""
    out, inline = [], []

    def flush() -> None:
        body = "".join(inline).strip()
        if body:
            out.append(("paragraph", 0, body, False))
        inline.clear()

    for kind, content, display in _pieces(text):
        if kind == "formula" and display:
            flush()
            out.append(("formula", 0, content, True))
        else:
            inline.append(content if kind == "text" else f"${content}$")
    flush()
    return out


def from_markdown(text: str) -> list[tuple[str, int, str, bool]]:
    """(kind, level, text, display) of headings at the start of a line, paragraphs, and display formulas, in order."""
    out: list = []
    for part in re.split(r"\n[ \t]*\n", text):
        held: list[str] = []
        for line in part.split("\n"):
            m = _HEADING.fullmatch(line.strip())
            if m:
                out += _paragraph("\n".join(held))
                held = []
                out.append(("heading", len(m[1]), m[2].strip(), False))
            else:
                held.append(line)
        out += _paragraph("\n".join(held))
    return out


def markdown_to_latex(text: str) -> str:
    """The blocks printed again, headings with their marks, formulas in dollar signs."""
    shown = {"heading": lambda b: "#" * b[1] + " " + b[2], "paragraph": lambda b: b[2], "formula": lambda b: f"$${b[2]}$$"}
    return "\n\n".join(shown[b[0]](b) for b in from_markdown(text))


def from_latex_document(text: str) -> list[tuple[str, int, str, bool]]:
    """Formulas between dollar signs as formula blocks (display for two), the trimmed text between them as paragraphs."""
    out = []
    for kind, content, display in _pieces(text):
        if kind == "formula":
            out.append(("formula", 0, content, display))
        elif content.strip():
            out.append(("paragraph", 0, content.strip(), False))
    return out


def inlines(text: str) -> list[tuple[str, bool | None]]:
    """Words (None) and formulas (displayed or not) of a paragraph, in order; blank words are left out."""
    out, done = [], 0
    for m in _MATH.finditer(text):
        out += [(text[done : m.start()], None), (m[1] or m[2], m[1] is not None)]
        done = m.end()
    return [x for x in [*out, (text[done:], None)] if x[0].strip()]


def with_inlines(text: str, change) -> str:
    """A paragraph with change(formula, displayed) in place of each formula and its dollar signs."""
    return _MATH.sub(lambda m: change(m[1] or m[2], m[1] is not None), text)
