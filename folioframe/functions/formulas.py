"""Formulas as trees: read from LaTeX, MathML, OMML or Typst, printed as any of them. Plain Python, no Spark.

A node is a tuple: ("row", nodes), ("atom", text), ("symbol", name), ("function", name), ("words", text),
("fraction", a, b), ("binomial", a, b), ("root", x, degree or None), ("scripts", base, sub or None, sup or None),
("accent", name, x), ("line", "over" or "under", x), ("font", name, x), ("color", name, x), ("fence", left, right, x),
("table", environment, rows of cells), ("brace", "over" or "under", x, note or None), ("stack", "over" or "under", x, what is
set there), ("cancel", x), ("unknown", command). Reading is bounded by the text's length and DEPTH.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from folioframe.functions import symbols as s

DEPTH = 200
MAX_XML = 1 << 20
_TOKEN = re.compile(r"\\[A-Za-z]+\*?|\\.|\s+|.", re.S)
_ACCENTS = {n: c for n, c, _ in s.ACCENTS} | {"widehat": "^", "widetilde": "~", "overrightarrow": "→"}
_FONTS = {n for n, *_ in s.FONTS} | {"bm", "mathscr"}
_FENCES = {"\\{": "{", "\\}": "}", "\\|": "‖", ".": ""}
ENVIRONMENTS = {"matrix": ("", ""), "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "Bmatrix": ("{", "}"), "vmatrix": ("|", "|"), "Vmatrix": ("‖", "‖"), "cases": ("{", ""), "aligned": ("", ""), "align": ("", ""), "array": ("", ""), "split": ("", ""), "gathered": ("", "")}


class FormulaError(ValueError):
    """Text that is not of its language."""


def row(nodes: list) -> tuple:
    return nodes[0] if len(nodes) == 1 else ("row", nodes)


# LaTeX


class _Latex:
    def __init__(self, text: str):
        self.t = _TOKEN.findall(text)
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def blank(self) -> None:
        while self.peek().isspace():
            self.i += 1

    def until(self, stops: tuple[str, ...], depth: int) -> tuple:
        out: list = []
        while True:
            self.blank()
            t = self.peek()
            if t == "" or t in stops:
                return row(out)
            if t in "^_":
                base = out.pop() if out else ("row", [])
                out.append(self.scripts(base, depth))
            elif t == "}" or t in ("\\limits", "\\nolimits"):
                self.take()
            else:
                out.append(self.one(depth + 1))

    def scripts(self, base: tuple, depth: int) -> tuple:
        sub = sup = None
        while self.peek() and self.peek() in "^_":
            mark = self.take()
            x = self.argument(depth)
            if mark == "^" and sup is None:
                sup = x
            elif mark == "_" and sub is None:
                sub = x
            else:
                base, sub, sup = ("scripts", base, sub, sup), x if mark == "_" else None, x if mark == "^" else None
            self.blank()
        return ("scripts", base, sub, sup)

    def argument(self, depth: int) -> tuple:
        self.blank()
        if self.peek().isdigit():
            return ("atom", self.take())  # a bare argument is one character
        return self.one(depth + 1) if self.peek() not in ("", "}") else ("row", [])

    def braced_text(self) -> str:
        self.blank()
        if self.peek() != "{":
            return self.take()
        self.take()
        level, out = 1, []
        while self.peek():
            t = self.take()
            level += (t == "{") - (t == "}")
            if not level:
                break
            out.append(t)
        return "".join(out)

    def bracket(self, depth: int) -> tuple | None:
        self.blank()
        if self.peek() != "[":
            return None
        self.take()
        x = self.until(("]",), depth)
        self.take()
        return x

    def fence(self) -> str:
        self.blank()
        t = self.take()
        return _FENCES.get(t, s.UNICODE.get(t[1:], t) if t.startswith("\\") else t)

    def one(self, depth: int) -> tuple:
        if depth > DEPTH:
            raise FormulaError("too deep")
        t = self.take()
        if t == "{":
            x = self.until(("}",), depth)
            self.take()
            return x
        if not t.startswith("\\"):
            if t.isdigit():
                while self.peek().isdigit() or self.peek() == ".":
                    t += self.take()
            return ("atom", t)
        name = t[1:]
        if name in ("frac", "dfrac", "tfrac", "binom", "dbinom"):
            a, b = self.argument(depth), self.argument(depth)
            return ("binomial" if "binom" in name else "fraction", a, b)
        if name == "sqrt":
            degree = self.bracket(depth)
            return ("root", self.argument(depth), degree)
        if name in _ACCENTS:
            return ("accent", {"widehat": "hat", "widetilde": "tilde", "overrightarrow": "vec"}.get(name, name), self.argument(depth))
        if name in ("overline", "underline"):
            return ("line", name[:-4], self.argument(depth))
        if name in ("overbrace", "underbrace"):
            x = self.argument(depth)
            self.blank()
            if self.peek() != ("^" if name == "overbrace" else "_"):
                return ("brace", name[:-5], x, None)
            self.take()
            return ("brace", name[:-5], x, self.argument(depth))
        if name in ("overset", "underset", "stackrel"):
            note, x = self.argument(depth), self.argument(depth)
            return ("stack", "under" if name == "underset" else "over", x, note)
        if name in ("cancel", "bcancel", "xcancel"):
            return ("cancel", self.argument(depth))
        if name in _FONTS:
            return ("font", {"bm": "boldsymbol", "mathscr": "mathcal"}.get(name, name), self.argument(depth))
        if name in ("text", "textrm", "textbf", "textit", "mbox", "operatorname"):
            words = self.braced_text()
            return ("function", words) if name == "operatorname" else ("words", words)
        if name in ("color", "textcolor"):
            color = self.braced_text()
            return ("color", color, self.argument(depth) if name == "textcolor" else self.until(("}", "&", "\\\\"), depth))
        if name == "left":
            a = self.fence()
            x = self.until(("\\right",), depth)
            if self.take() == "\\right":
                return ("fence", a, self.fence(), x)
            return ("fence", a, "", x)
        if name == "begin":
            return self.table(self.braced_text(), depth)
        if name == "end":
            self.braced_text()
            return ("row", [])
        if name in s.FUNCTIONS:
            return ("function", name)
        if name in s.UNICODE:
            return ("symbol", name)
        if name in ("{", "}", "%", "$", "&", "#", "_"):
            return ("atom", name)
        if name in (",", ";", ":", "!", " ", "quad", "qquad", "\\", "displaystyle", "limits", "nolimits", "right"):
            return ("row", [])
        if name == "|":
            return ("atom", "‖")
        return ("unknown", name)

    def table(self, environment: str, depth: int) -> tuple:
        if environment == "array":
            self.braced_text()
        rows: list = [[]]
        while True:
            rows[-1].append(self.until(("&", "\\\\", "\\end"), depth + 1))
            t = self.take()
            if t == "\\\\":
                rows.append([])
            elif t != "&":
                if t == "\\end":
                    self.braced_text()
                break
        if len(rows) > 1 and rows[-1] == [("row", [])]:
            rows.pop()
        return ("table", environment.rstrip("*"), rows)


def from_latex(text: str) -> tuple:
    """The tree of LaTeX, with or without dollar signs around it."""
    bare = text.strip()
    for mark in ("$$", "$"):
        if bare.startswith(mark) and bare.endswith(mark) and len(bare) >= 2 * len(mark):
            bare = bare[len(mark) : len(bare) - len(mark)]
            break
    return _Latex(bare).until((), 0)


def _group(x: tuple) -> str:
    return "{" + to_latex(x) + "}"


def _latex_fence(c: str) -> str:
    return {"": ".", "{": "\\{", "}": "\\}", "‖": "\\|"}.get(c, "\\" + s.FROM_UNICODE[c] if c in s.FROM_UNICODE else c)


def to_latex(n: tuple) -> str:
    kind = n[0]
    if kind == "row":
        return " ".join(x for x in map(to_latex, n[1]) if x)
    if kind == "atom":
        return "\\" + n[1] if n[1] in tuple("{}%$&#_") else "\\|" if n[1] == "‖" else n[1]
    if kind in ("symbol", "unknown"):
        return "\\" + n[1]
    if kind == "function":
        return "\\" + n[1] if n[1] in s.FUNCTIONS else "\\operatorname{" + n[1] + "}"
    if kind == "words":
        return "\\text{" + n[1] + "}"
    if kind in ("fraction", "binomial"):
        return ("\\frac" if kind == "fraction" else "\\binom") + _group(n[1]) + _group(n[2])
    if kind == "root":
        return "\\sqrt" + ("[" + to_latex(n[2]) + "]" if n[2] is not None else "") + _group(n[1])
    if kind == "scripts":
        base = to_latex(n[1])
        base = "{" + base + "}" if n[1][0] in ("row", "scripts") else base
        return base + ("_" + _group(n[2]) if n[2] is not None else "") + ("^" + _group(n[3]) if n[3] is not None else "")
    if kind in ("accent", "font"):
        return "\\" + n[1] + _group(n[2])
    if kind == "line":
        return "\\" + n[1] + "line" + _group(n[2])
    if kind == "brace":
        return "\\" + n[1] + "brace" + _group(n[2]) + (("^" if n[1] == "over" else "_") + _group(n[3]) if n[3] is not None else "")
    if kind == "stack":
        return "\\" + n[1] + "set" + _group(n[3]) + _group(n[2])
    if kind == "cancel":
        return "\\cancel" + _group(n[1])
    if kind == "color":
        return "\\textcolor{" + n[1] + "}" + _group(n[2])
    if kind == "fence":
        return "\\left" + _latex_fence(n[1]) + " " + to_latex(n[3]) + " \\right" + _latex_fence(n[2])
    body = " \\\\ ".join(" & ".join(map(to_latex, r)) for r in n[2])
    return "\\begin{" + n[1] + "}" + ("{" + "c" * max(map(len, n[2])) + "}" if n[1] == "array" else "") + " " + body + " \\end{" + n[1] + "}"


# Typst

_TYPST_ACCENT = {n: t for n, _, t in s.ACCENTS}
_TYPST_FONT = {n: t for n, _, _, t in s.FONTS}


def to_typst(n: tuple) -> str:
    """Accents print as a bare name before what they mark, as the established output has them."""
    kind = n[0]
    if kind == "row":
        return " ".join(x for x in map(to_typst, n[1]) if x)
    if kind == "atom":
        return "\\" + n[1] if n[1] in tuple("#$_&") else n[1]
    if kind == "symbol":
        return s.TYPST[n[1]]
    if kind == "unknown":
        return f'"{n[1]}"'
    if kind == "function":
        return n[1] if n[1] in s.FUNCTIONS else f'op("{n[1]}")'
    if kind == "words":
        return '"' + n[1].replace('"', "'") + '"'
    if kind in ("fraction", "binomial"):
        return ("frac(" if kind == "fraction" else "binom(") + to_typst(n[1]) + ", " + to_typst(n[2]) + ")"
    if kind == "root":
        return f"sqrt({to_typst(n[1])})" if n[2] is None else f"root({to_typst(n[2])}, {to_typst(n[1])})"
    if kind == "scripts":
        base = to_typst(n[1])
        base = f"({base})" if n[1][0] in ("row", "scripts") and base else base
        return base + (f"_({to_typst(n[2])})" if n[2] is not None else "") + (f"^({to_typst(n[3])})" if n[3] is not None else "")
    if kind == "accent":
        return f"{_TYPST_ACCENT[n[1]] if n[1] != 'hat' else 'hat'} {to_typst(n[2])}"
    if kind == "line":
        return f"{n[1]}line({to_typst(n[2])})"
    if kind == "brace":
        return f"{n[1]}brace({to_typst(n[2])}{', ' + to_typst(n[3]) if n[3] is not None else ''})"
    if kind == "stack":
        return f"{n[1]}set({to_typst(n[3])}, {to_typst(n[2])})"
    if kind == "cancel":
        return f"cancel({to_typst(n[1])})"
    if kind == "font":
        return f"{_TYPST_FONT[n[1]]}({to_typst(n[2])})"
    if kind == "color":
        return f'#text(fill: rgb("{s.color_hex(n[1]).lower()}"))[$ {to_typst(n[2])} $]'
    if kind == "fence":
        return f"lr({n[1]} {to_typst(n[3])} {n[2]})"
    cells = "; ".join(", ".join(map(to_typst, r)) for r in n[2])
    if n[1] == "cases":
        return "cases(" + ", ".join(" & ".join(map(to_typst, r)) for r in n[2]) + ")"
    left = ENVIRONMENTS.get(n[1], ("", ""))[0]
    return f'mat(delim: "{left}", {cells})' if left else f"mat(delim: #none, {cells})"


_TYPST_TOKEN = re.compile(r'"[^"]*"|[A-Za-z][A-Za-z.]*[A-Za-z]|[A-Za-z]|\d+(?:\.\d+)?|\\.|\s+|.', re.S)
_FROM_ACCENT = {t: n for n, _, t in s.ACCENTS} | {"arrow": "vec", "macron": "bar"}
_FROM_FONT = {t: n for n, _, _, t in s.FONTS if n != "boldsymbol"} | {"serif": "mathrm"}


#: The doubled capitals that stand for sets of numbers.
_DOUBLED = ("NN", "ZZ", "QQ", "RR", "CC")


class _Typst:
    def __init__(self, text: str):
        self.t = [x for x in _TYPST_TOKEN.findall(text) if not x.isspace()]
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def until(self, stops: tuple[str, ...], depth: int) -> tuple:
        out: list = []
        while self.peek() and self.peek() not in stops:
            if self.peek() in "^_" and self.peek():
                base, sub, sup = (out.pop() if out else ("row", [])), None, None
                while self.peek() and self.peek() in "^_":
                    mark, x = self.take(), self.argument(depth)
                    sub, sup = (x, sup) if mark == "_" else (sub, x)
                out.append(("scripts", base, sub, sup))
            elif self.peek() == "/" and out:
                self.take()
                out.append(("fraction", out.pop(), self.argument(depth)))
            else:
                out.append(self.one(depth + 1))
        return row(out)

    def argument(self, depth: int) -> tuple:
        if self.peek() == "(":
            self.take()
            x = self.until((")",), depth + 1)
            self.take()
            return x
        return self.one(depth + 1) if self.peek() else ("row", [])

    def call(self, depth: int) -> list[list[tuple]]:
        """Arguments by rows (split at semicolons) of a call whose parenthesis is next."""
        self.take()
        rows: list = [[]]
        while self.peek() and self.peek() != ")":
            rows[-1].append(self.until((",", ";", ")"), depth + 1))
            if self.peek() in (",", ";") and self.take() == ";":
                rows.append([])
        self.take()
        return rows

    def one(self, depth: int) -> tuple:
        if depth > DEPTH:
            raise FormulaError("too deep")
        t = self.take()
        called = self.peek() == "("
        if t.startswith('"'):
            return ("words", t.strip('"'))
        if t.startswith("\\"):
            return ("atom", t[1:])
        if t in ("frac", "binom") and called:
            a, b, *_ = [*self.call(depth)[0], ("row", []), ("row", [])]
            return ("fraction" if t == "frac" else "binomial", a, b)
        if t == "sqrt" and called:
            return ("root", self.argument(depth), None)
        if t == "root" and called:
            degree, x, *_ = [*self.call(depth)[0], ("row", []), ("row", [])]
            return ("root", x, degree)
        if t == "lr" and called:
            self.take()
            left = self.take()
            inner = self.until((")", "]", "}", "|"), depth)
            right = self.take()
            if self.peek() == ")":
                self.take()
            else:
                right = "" if right == ")" and left not in ("(",) else right
            return ("fence", left, right, inner)
        if t in ("mat", "vec") and called:
            rows = self.call(depth)
            delim = "("
            if rows and rows[0] and to_latex(rows[0][0]).startswith("d e l i m"):
                words = next((x[1] for x in rows[0][0][1] if x[0] == "words"), "") if rows[0][0][0] == "row" else ""
                delim, rows[0] = words, rows[0][1:]
            if t == "vec":
                rows = [[x] for x in rows[0]]
            return ("table", next((e for e, (a, _) in ENVIRONMENTS.items() if a == delim and e.endswith("matrix")), "matrix"), rows)
        if t == "cases" and called:
            self.take()
            rows = [[]]
            while self.peek() and self.peek() != ")":
                rows[-1].append(self.until((",", "&", ")"), depth + 1))
                if self.peek() in (",", "&") and self.take() == ",":
                    rows.append([])
            self.take()
            return ("table", "cases", rows)
        if t == "op" and called:
            x = self.argument(depth)
            return ("function", x[1] if x[0] == "words" else to_latex(x))
        if t in _FROM_ACCENT and (called or t == "hat"):
            return ("accent", _FROM_ACCENT[t], self.argument(depth))
        if t in ("overline", "underline") and called:
            return ("line", t[:-4], self.argument(depth))
        if t in ("overbrace", "underbrace") and called:
            x, note, *_ = [*self.call(depth)[0], None, None]
            return ("brace", t[:-5], x or ("row", []), note)
        if t in ("overset", "underset") and called:
            note, x, *_ = [*self.call(depth)[0], ("row", []), ("row", [])]
            return ("stack", t[:-3], x, note)
        if t == "cancel" and called:
            return ("cancel", self.argument(depth))
        if t in _DOUBLED:
            return ("font", "mathbb", ("atom", t[0]))
        if t in _FROM_FONT and called:
            return ("font", _FROM_FONT[t], self.argument(depth))
        if t in s.FROM_TYPST:
            return ("symbol", s.FROM_TYPST[t])
        if t in s.FUNCTIONS:
            return ("function", t)
        if len(t) > 1 and t[0].isalpha():
            return row([("atom", c) for c in t])
        return ("atom", t)


def from_typst(text: str) -> tuple:
    return _Typst(text.strip().strip("$")).until((), 0)


# XML

_MATHML = "http://www.w3.org/1998/Math/MathML"
_OMML = "http://schemas.openxmlformats.org/officeDocument/2006/math"


def _escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _read_xml(text: str) -> ET.Element:
    if len(text) > MAX_XML:
        raise FormulaError("too large")
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise FormulaError("document types and entities are not read")
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError as e:
        raise FormulaError(str(e)) from None


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


#: The braces that stretch above and below, and the names of characters that MathML is often written with.
_BRACES = {"over": "⏞", "under": "⏟"}
_ENTITIES = {"nbsp": " ", "minus": "−", "times": "×", "sdot": "⋅", "middot": "·", "plusmn": "±", "le": "≤", "ge": "≥", "ne": "≠", "infin": "∞", "part": "∂", "sum": "∑", "prod": "∏", "int": "∫", "radic": "√", "rarr": "→", "larr": "←", "isin": "∈", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "theta": "θ", "lambda": "λ", "mu": "μ", "sigma": "σ", "omega": "ω", "ApplyFunction": "", "InvisibleTimes": ""}
_FONT_VARIANT = {n: v for n, v, _, _ in s.FONTS}
_VARIANT_FONT = {v: n for n, v in reversed(_FONT_VARIANT.items())}


def _mml(n: tuple, p: str) -> str:
    def tag(name: str, *inner: str, attributes: str = "") -> str:
        return f"<{p}{name}{attributes}>{''.join(inner)}</{p}{name}>"

    m = lambda x: _mml(x, p)
    kind = n[0]
    if kind == "row":
        return tag("mrow", *map(m, n[1]))
    if kind == "atom":
        name = "mn" if n[1][:1].isdigit() else "mi" if n[1].isalpha() else "mo"
        return tag(name, _escape(n[1]))
    if kind == "symbol":
        return tag("mi" if s.CLASS[n[1]] == "greek" or n[1] in ("infty", "ell", "hbar", "emptyset", "aleph") else "mo", _escape(s.UNICODE[n[1]]))
    if kind in ("function", "unknown"):
        return tag("mi", _escape(n[1]))
    if kind == "words":
        return tag("mtext", _escape(n[1]))
    if kind == "fraction":
        return tag("mfrac", m(n[1]), m(n[2]))
    if kind == "binomial":
        return tag("mrow", tag("mo", "("), tag("mfrac", m(n[1]), m(n[2]), attributes=' linethickness="0"'), tag("mo", ")"))
    if kind == "root":
        return tag("msqrt", m(n[1])) if n[2] is None else tag("mroot", m(n[1]), m(n[2]))
    if kind == "scripts":
        large = n[1][0] == "symbol" and s.CLASS[n[1][1]] == "operator" or n[1] == ("function", "lim")
        under, over, both = ("munder", "mover", "munderover") if large else ("msub", "msup", "msubsup")
        if n[2] is not None and n[3] is not None:
            return tag(both, m(n[1]), m(n[2]), m(n[3]))
        return tag(under, m(n[1]), m(n[2])) if n[2] is not None else tag(over, m(n[1]), m(n[3]))
    if kind == "accent":
        return tag("mover", m(n[2]), tag("mo", _escape(_ACCENTS[n[1]])), attributes=' accent="true"')
    if kind == "line":
        return tag("m" + n[1], m(n[2]), tag("mo", "‾" if n[1] == "over" else "_"))
    if kind == "brace":
        braced = tag("m" + n[1], m(n[2]), tag("mo", _BRACES[n[1]], attributes=' stretchy="true"'))
        return braced if n[3] is None else tag("m" + n[1], braced, m(n[3]))
    if kind == "stack":
        return tag("m" + n[1], m(n[2]), m(n[3]), attributes=' class="stack"')
    if kind == "cancel":
        return tag("menclose", m(n[1]), attributes=' notation="updiagonalstrike"')
    if kind == "font":
        return tag("mstyle", m(n[2]), attributes=f' mathvariant="{_FONT_VARIANT[n[1]]}"')
    if kind == "color":
        return tag("mstyle", m(n[2]), attributes=f' mathcolor="#{s.color_hex(n[1])}"')
    if kind == "fence":
        return tag("mrow", tag("mo", _escape(n[1]), attributes=' fence="true"'), m(n[3]), tag("mo", _escape(n[2]), attributes=' fence="true"'))
    table = tag("mtable", *(tag("mtr", *(tag("mtd", m(c)) for c in r)) for r in n[2]))
    left, right = ENVIRONMENTS.get(n[1], ("", ""))
    if not left:
        return table
    return tag("mrow", tag("mo", _escape(left), attributes=' fence="true"'), table, tag("mo", _escape(right), attributes=' fence="true"'))


def to_mathml(n: tuple, display: bool = True, style: str = "plain") -> str:
    """style: plain, mml (every tag with that prefix), m (likewise), or attr (an attribute says inline)."""
    p = {"mml": "mml:", "m": "m:"}.get(style, "")
    named = f"xmlns:{p[:-1]}" if p else "xmlns"
    how = ' mathmode="inline"' if style == "attr" else f' display="{"block" if display else "inline"}"'
    return f'<{p}math {named}="{_MATHML}"{how}>{_mml(n, p)}</{p}math>'


def _symbol_or_atom(t: str) -> tuple:
    t = t.strip()
    if t in s.FROM_UNICODE:
        return ("symbol", s.FROM_UNICODE[t])
    if t in s.FUNCTIONS:
        return ("function", t)
    if len(t) > 1 and t.isalpha():
        return ("font", "mathrm", row([("atom", c) for c in t]))
    return ("atom", t) if t else ("row", [])


def _from_mml(e: ET.Element, depth: int = 0) -> tuple:
    if depth > DEPTH:
        raise FormulaError("too deep")
    name, kids = _local(e), [x for x in e if isinstance(x.tag, str)]
    go = lambda x: _from_mml(x, depth + 1)
    pick = lambda i: go(kids[i]) if i < len(kids) else ("row", [])
    if name in ("mi", "mn", "mo"):
        return _symbol_or_atom("".join(e.itertext()))
    if name in ("mtext", "ms"):
        return ("words", "".join(e.itertext()))
    if name == "mfrac":
        return ("binomial" if e.get("linethickness") == "0" else "fraction", pick(0), pick(1))
    if name == "msqrt":
        return ("root", row([go(x) for x in kids]), None)
    if name == "mroot":
        return ("root", pick(0), pick(1))
    if name == "mmultiscripts":
        split = next((i for i, x in enumerate(kids) if _local(x) == "mprescripts"), len(kids))
        script = lambda i: None if i >= len(kids) or _local(kids[i]) in ("none", "mprescripts") else go(kids[i])
        base = pick(0)
        for i in range(1, split - 1, 2):
            base = ("scripts", base, script(i), script(i + 1))
        before = [("scripts", ("row", []), script(i), script(i + 1)) for i in range(split + 1, len(kids) - 1, 2)]
        return row([*before, base])
    if name == "mfenced":
        left, right, marks = e.get("open", "("), e.get("close", ")"), e.get("separators", ",").strip()
        inner = []
        for i, x in enumerate(kids):
            inner += [("atom", marks[min(i, len(marks)) - 1])] * bool(i and marks) + [go(x)]
        return ("fence", left, right, row(inner))
    if name == "menclose":
        x, how = row([go(k) for k in kids]), e.get("notation", "longdiv")
        if "radical" in how:
            return ("root", x, None)
        if "strike" in how:
            return ("cancel", x)
        return ("line", "over", x) if "top" in how else ("line", "under", x) if "bottom" in how else x
    if name in ("msup", "msub", "msubsup", "munder", "munderover", "mover"):
        if name in ("mover", "munder") and len(kids) > 1 and "".join(kids[1].itertext()).strip() == _BRACES[name[1:]]:
            return ("brace", name[1:], pick(0), None)
        if name in ("mover", "munder") and len(kids) > 1:
            x = pick(0)
            if x[0] == "brace" and x[1] == name[1:] and x[3] is None:
                return ("brace", x[1], x[2], pick(1))
            if e.get("class") == "stack":
                return ("stack", name[1:], x, pick(1))
        if name in ("mover", "munder") and len(kids) > 1:
            mark = "".join(kids[1].itertext()).strip()
            if mark in ("‾", "_") and _local(kids[1]) == "mo":
                return ("line", "over" if name == "mover" else "under", pick(0))
            accent = next((n for n, c, _ in s.ACCENTS if c == mark), None)
            if name == "mover" and accent and (e.get("accent") == "true" or mark != "→"):
                return ("accent", accent, pick(0))
        sub = pick(1) if name in ("msub", "msubsup", "munder", "munderover") else None
        sup = pick(2) if name in ("msubsup", "munderover") else pick(1) if name in ("msup", "mover") else None
        return ("scripts", pick(0), sub, sup)
    if name == "mtable":
        return ("table", "matrix", [[row([go(x) for x in cell if isinstance(x.tag, str)]) for cell in r if isinstance(cell.tag, str)] for r in kids])
    inner = [go(x) for x in kids if _local(x) != "annotation"]
    if name == "mrow" and len(inner) == 3 and kids[0].get("fence") and kids[2].get("fence"):
        left, right = ("".join(kids[i].itertext()).strip() for i in (0, 2))
        if inner[1][0] == "table":
            return ("table", next((n for n, f in ENVIRONMENTS.items() if f == (left, right)), "matrix"), inner[1][2])
        return ("fence", left, right, inner[1])
    if name == "mrow" and len(inner) == 3 and inner[1][0] == "binomial" and inner[0] == ("atom", "("):
        return inner[1]
    if name == "mspace":
        return ("row", [])
    x = row(inner)
    if name == "mstyle" and e.get("mathvariant") in _VARIANT_FONT:
        return ("font", _VARIANT_FONT[e.get("mathvariant")], x)
    if name == "mstyle" and e.get("mathcolor"):
        return ("color", e.get("mathcolor").removeprefix("#"), x)
    return x


def from_mathml(text: str) -> tuple:
    """The tree of MathML; FormulaError if it is not well-formed, empty, or declares entities."""
    bare = re.sub(r"(</?)(mml|m):", r"\1", text) if "xmlns:" not in text else text
    if not bare.strip():
        raise FormulaError("empty")
    bare = re.sub(r"&([A-Za-z]+);", lambda m: _ENTITIES.get(m[1], m[0]), bare)
    return _from_mml(_read_xml(bare))


def _run(text: str, properties: str = "") -> str:
    return f'<m:r>{properties}<m:t xml:space="preserve">{_escape(text)}</m:t></m:r>'


_SCRIPT = {n: x for n, _, x, _ in s.FONTS}
_FROM_SCRIPT = {x: n for n, x in reversed(_SCRIPT.items())}


def _omml(n: tuple, properties: str = "") -> str:
    o = lambda x: _omml(x, properties)
    e = lambda name, x: f"<m:{name}>{o(x)}</m:{name}>"
    kind = n[0]
    if kind == "row":
        return "".join(map(o, n[1]))
    if kind == "symbol":
        return _run(s.UNICODE[n[1]], properties)
    if kind in ("atom", "unknown"):
        return _run(n[1], properties)
    if kind == "function":
        return _run(n[1], '<m:rPr><m:sty m:val="p"/></m:rPr>')
    if kind == "words":
        return _run(n[1], "<m:rPr><m:nor/></m:rPr>")
    if kind == "fraction":
        return f"<m:f>{e('num', n[1])}{e('den', n[2])}</m:f>"
    if kind == "binomial":
        return f'<m:d><m:dPr><m:begChr m:val="("/><m:endChr m:val=")"/></m:dPr><m:e><m:f><m:fPr><m:type m:val="noBar"/></m:fPr>{e("num", n[1])}{e("den", n[2])}</m:f></m:e></m:d>'
    if kind == "root":
        return f'<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/>{e("e", n[1])}</m:rad>' if n[2] is None else f"<m:rad>{e('deg', n[2])}{e('e', n[1])}</m:rad>"
    if kind == "scripts":
        if n[1][0] == "symbol" and s.CLASS[n[1][1]] == "operator":
            sub, sup = (e(k, x) if x is not None else f"<m:{k}/>" for k, x in (("sub", n[2]), ("sup", n[3])))
            return f'<m:nary><m:naryPr><m:chr m:val="{s.UNICODE[n[1][1]]}"/></m:naryPr>{sub}{sup}<m:e/></m:nary>'
        if n[2] is not None and n[3] is not None:
            return f"<m:sSubSup>{e('e', n[1])}{e('sub', n[2])}{e('sup', n[3])}</m:sSubSup>"
        return f"<m:sSub>{e('e', n[1])}{e('sub', n[2])}</m:sSub>" if n[2] is not None else f"<m:sSup>{e('e', n[1])}{e('sup', n[3])}</m:sSup>"
    if kind == "accent":
        return f'<m:acc><m:accPr><m:chr m:val="{_escape(_ACCENTS[n[1]])}"/></m:accPr>{e("e", n[2])}</m:acc>'
    if kind == "line":
        return f'<m:bar><m:barPr><m:pos m:val="{"top" if n[1] == "over" else "bot"}"/></m:barPr>{e("e", n[2])}</m:bar>'
    if kind == "brace":
        place = "top" if n[1] == "over" else "bot"
        if n[3] is None:
            return f'<m:groupChr><m:groupChrPr><m:chr m:val="{_BRACES[n[1]]}"/><m:pos m:val="{place}"/></m:groupChrPr>{e("e", n[2])}</m:groupChr>'
        limit = "limUpp" if n[1] == "over" else "limLow"
        return f'<m:{limit}><m:e><m:bar><m:barPr><m:pos m:val="{place}"/></m:barPr>{e("e", n[2])}</m:bar></m:e>{e("lim", n[3])}</m:{limit}>'
    if kind == "stack":
        limit = "limUpp" if n[1] == "over" else "limLow"
        return f"<m:{limit}>{e('e', n[2])}{e('lim', n[3])}</m:{limit}>"
    if kind == "cancel":
        return f'<m:borderBox><m:borderBoxPr><m:hideTop m:val="1"/><m:hideBot m:val="1"/><m:hideLeft m:val="1"/><m:hideRight m:val="1"/><m:strikeBLTR m:val="1"/></m:borderBoxPr>{e("e", n[1])}</m:borderBox>'
    if kind == "font":
        style = _SCRIPT[n[1]]
        return _omml(n[2], f'<m:rPr><m:{"sty" if len(style) < 3 else "scr"} m:val="{style}"/></m:rPr>')
    if kind == "color":
        return _omml(n[2], f'<m:rPr><w:color xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" w:val="{s.color_hex(n[1])}"/></m:rPr>')
    if kind == "fence":
        return f'<m:d><m:dPr><m:begChr m:val="{_escape(n[1])}"/><m:endChr m:val="{_escape(n[2])}"/></m:dPr>{e("e", n[3])}</m:d>'
    table = "<m:m>" + "".join("<m:mr>" + "".join(e("e", c) for c in r) + "</m:mr>" for r in n[2]) + "</m:m>"
    left, right = ENVIRONMENTS.get(n[1], ("", ""))
    return f'<m:d><m:dPr><m:begChr m:val="{_escape(left)}"/><m:endChr m:val="{_escape(right)}"/></m:dPr><m:e>{table}</m:e></m:d>' if left else table


def to_omml(n: tuple, display: bool = True) -> str:
    inner = f"<m:oMath>{_omml(n)}</m:oMath>"
    if display:
        return f'<m:oMathPara xmlns:m="{_OMML}">{inner}</m:oMathPara>'
    return inner.replace("<m:oMath>", f'<m:oMath xmlns:m="{_OMML}">', 1)


def _value(e: ET.Element, path: str, default: str) -> str:
    at = e
    for name in path.split("/"):
        at = next((x for x in at if _local(x) == name), None)
        if at is None:
            return default
    return next((v for k, v in at.attrib.items() if k.rsplit("}", 1)[-1] == "val"), default)


def _from_omml(e: ET.Element, depth: int = 0) -> tuple:
    if depth > DEPTH:
        raise FormulaError("too deep")
    name = _local(e)
    go = lambda x: _from_omml(x, depth + 1)

    def part(k: str) -> tuple:
        x = next((x for x in e if _local(x) == k), None)
        return row([go(y) for y in x if not _local(y).endswith("Pr")]) if x is not None else ("row", [])

    if name == "r":
        text = "".join(t.text or "" for t in e if _local(t) == "t")
        if any(_local(x) == "nor" for p in e if _local(p) == "rPr" for x in p):
            return ("words", text)
        if text.strip() in s.FUNCTIONS:
            return ("function", text.strip())
        x = row([_symbol_or_atom(c) for c in (re.findall(r"\d+(?:\.\d+)?|\S", text))])
        style = _value(e, "rPr/scr", "") or _value(e, "rPr/sty", "")
        return ("font", _FROM_SCRIPT[style], x) if style in _FROM_SCRIPT and style != "p" else x
    if name == "f":
        return ("binomial" if _value(e, "fPr/type", "") == "noBar" else "fraction", part("num"), part("den"))
    if name in ("sSup", "sSub", "sSubSup"):
        return ("scripts", part("e"), part("sub") if "Sub" in name else None, part("sup") if "Sup" in name else None)
    if name == "rad":
        degree = part("deg")
        return ("root", part("e"), None if degree == ("row", []) else degree)
    if name == "nary":
        sign, sub, sup = _symbol_or_atom(_value(e, "naryPr/chr", "∫")), part("sub"), part("sup")
        return row([("scripts", sign, None if sub == ("row", []) else sub, None if sup == ("row", []) else sup), *([part("e")] if part("e") != ("row", []) else [])])
    if name == "d":
        left, right, x = _value(e, "dPr/begChr", "("), _value(e, "dPr/endChr", ")"), part("e")
        if x[0] == "binomial":
            return x
        if x[0] == "table":
            return ("table", next((n for n, f in ENVIRONMENTS.items() if f == (left, right)), "matrix"), x[2])
        return ("fence", left, right, x)
    if name == "bar":
        return ("line", "over" if _value(e, "barPr/pos", "bot") == "top" else "under", part("e"))
    if name == "groupChr":
        side = "over" if _value(e, "groupChrPr/pos", "bot") == "top" else "under"
        return ("brace", side, part("e"), None)
    if name in ("limUpp", "limLow"):
        side, x = "over" if name == "limUpp" else "under", part("e")
        if x[0] == "line" or x[0] == "brace" and x[3] is None:
            return ("brace", side, x[2], part("lim"))
        return ("scripts", x, part("lim"), None) if side == "under" and x[0] == "function" else ("stack", side, x, part("lim"))
    if name == "sPre":
        return row([("scripts", ("row", []), part("sub"), part("sup")), part("e")])
    if name == "borderBox" and _value(e, "borderBoxPr/strikeBLTR", "0") in ("1", "on", "true"):
        return ("cancel", part("e"))
    if name == "acc":
        mark = _value(e, "accPr/chr", "^")
        return ("accent", next((n for n, c, _ in s.ACCENTS if c == mark), "hat"), part("e"))
    if name in ("eqArr", "m"):
        rows = [x for x in e if _local(x) in ("e", "mr")]
        cells = lambda r: [row([go(y) for y in c if not _local(y).endswith("Pr")]) for c in r if _local(c) == "e"] if _local(r) == "mr" else [row([go(y) for y in r])]
        return ("table", "aligned" if name == "eqArr" else "matrix", [cells(r) for r in rows])
    return row([go(x) for x in e if not _local(x).endswith("Pr")])


def from_omml(text: str) -> tuple:
    """The tree of OMML; the namespace may be missing, and the markup escaped."""
    if "<" not in text and "&lt;" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    found = re.search(r"<m:(oMathPara|oMath)\b.*</m:\1>", text, re.S)
    if not found:
        raise FormulaError("no formula")
    bare = found[0]
    if "xmlns:m=" not in bare:
        bare = re.sub(r"^<m:(\w+)", rf'<m:\1 xmlns:m="{_OMML}"', bare)
    return _from_omml(_read_xml(bare))


READERS = {"latex": from_latex, "mathml": from_mathml, "omml": from_omml, "typst": from_typst}
WRITERS = {
    "latex": lambda n, d: f"$${to_latex(n)}$$" if d else f"${to_latex(n)}$",
    "latex_display": lambda n, d: f"\\[{to_latex(n)}\\]",
    "latex_equation": lambda n, d: f"\\begin{{equation}}\n{to_latex(n)}\n\\end{{equation}}",
    "typst": lambda n, d: f"$ {to_typst(n)} $" if d else f"${to_typst(n)}$",
    "markdown": lambda n, d: f"$${to_latex(n)}$$" if d else f"${to_latex(n)}$",
    "html": lambda n, d: f"\\[{_escape(to_latex(n))}\\]" if d else f"\\({_escape(to_latex(n))}\\)",
    "mathml": lambda n, d: to_mathml(n, d),
    "mathml_mml": lambda n, d: to_mathml(n, d, "mml"),
    "mathml_m": lambda n, d: to_mathml(n, d, "m"),
    "mathml_attr": lambda n, d: to_mathml(n, d, "attr"),
    "omml": lambda n, d: to_omml(n, d),
}


WRITERS["typst_bare"] = lambda n, d: to_typst(n) if d else f"${to_typst(n)}$"


def try_convert(latex: str, target: str, display: bool = True) -> str:
    """A LaTeX formula in another format, or as it is where it cannot be read."""
    try:
        return WRITERS[target](from_latex(latex), display)
    except (FormulaError, RecursionError):
        return latex


def markup(text: str, target: str, display: bool | None) -> str:
    """A formula, or words where display is None, as a part of a document in mathml_<style> or omml."""
    if target == "omml":
        return _run(text, "<m:rPr><m:nor/></m:rPr>") if display is None else try_convert(text, "omml", display)
    p = {"mathml_mml": "mml:", "mathml_m": "m:"}.get(target, "")
    if display is None:
        return f"<{p}mtext>{_escape(text)}</{p}mtext>"
    try:
        inner = _mml(from_latex(text), p)
    except (FormulaError, RecursionError):
        inner = f"<{p}mtext>{_escape(text)}</{p}mtext>"
    how = "display" if display else "inline"
    return f"<{how}math>\n{inner}\n</{how}math>"


def convert(text: str, source: str, target: str, display: bool = True) -> str:
    return WRITERS[target](READERS[source](text), display)


def nodes(tree: tuple) -> list[tuple[int, int | None, int, int, str, str]]:
    """Pre-order rows (node, parent, depth, ordinal, kind, value)."""
    out: list = []

    def visit(n: tuple, parent: int | None, depth: int, ordinal: int) -> None:
        own = len(out)
        kids, value = [], ""
        for x in n[1:]:
            if isinstance(x, tuple):
                kids.append(x)
            elif isinstance(x, list):
                kids += [c for r in x for c in (r if isinstance(r, list) else [r])]
            elif x is not None:
                value += str(x)
        out.append((own, parent, depth, ordinal, n[0], value))
        for i, k in enumerate(kids):
            visit(k, own, depth + 1, i)

    visit(tree, None, 0, 0)
    return out
