"""One table of mathematical symbols: LaTeX name, character, Typst name, class.

Greek letters follow a rule: Unicode names them as LaTeX does. The rest are fixed values.
"""

from __future__ import annotations

import unicodedata

_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
_GREEK_CAPITAL = "Gamma Delta Theta Xi Pi Sigma Upsilon Phi Psi Omega".split()

#: Fixed values: (LaTeX, character, Typst), by class.
OPERATORS = (
    ("sum", "∑", "sum"), ("prod", "∏", "product"), ("int", "∫", "integral"), ("iint", "∬", "integral.double"), ("iiint", "∭", "integral.triple"), ("oint", "∮", "integral.cont"),
    ("bigcup", "⋃", "union.big"), ("bigcap", "⋂", "sect.big"), ("coprod", "∐", "product.co"),
)
RELATIONS = (
    ("leq", "≤", "lt.eq"), ("le", "≤", "lt.eq"), ("geq", "≥", "gt.eq"), ("ge", "≥", "gt.eq"), ("neq", "≠", "eq.not"), ("ne", "≠", "eq.not"), ("approx", "≈", "approx"), ("equiv", "≡", "equiv"),
    ("sim", "∼", "tilde.op"), ("simeq", "≃", "tilde.eq"), ("cong", "≅", "tilde.equiv"), ("propto", "∝", "prop"), ("in", "∈", "in"), ("notin", "∉", "in.not"), ("ni", "∋", "in.rev"),
    ("subset", "⊂", "subset"), ("supset", "⊃", "supset"), ("subseteq", "⊆", "subset.eq"), ("supseteq", "⊇", "supset.eq"), ("ll", "≪", "lt.double"), ("gg", "≫", "gt.double"),
    ("perp", "⊥", "perp"), ("parallel", "∥", "parallel"), ("mid", "∣", "divides"), ("prec", "≺", "prec"), ("succ", "≻", "succ"), ("models", "⊨", "models"), ("vdash", "⊢", "tack.r"),
)
SIGNS = (
    ("pm", "±", "plus.minus"), ("mp", "∓", "minus.plus"), ("times", "×", "times"), ("div", "÷", "div"), ("cdot", "⋅", "dot.op"), ("ast", "∗", "ast.op"), ("star", "⋆", "star.op"), ("circ", "∘", "compose"),
    ("cup", "∪", "union"), ("cap", "∩", "sect"), ("setminus", "∖", "without"), ("wedge", "∧", "and"), ("vee", "∨", "or"), ("oplus", "⊕", "plus.circle"), ("otimes", "⊗", "times.circle"), ("neg", "¬", "not"),
    ("to", "→", "arrow.r"), ("rightarrow", "→", "arrow.r"), ("leftarrow", "←", "arrow.l"), ("Rightarrow", "⇒", "arrow.r.double"), ("Leftarrow", "⇐", "arrow.l.double"), ("leftrightarrow", "↔", "arrow.l.r"),
    ("Leftrightarrow", "⇔", "arrow.l.r.double"), ("mapsto", "↦", "arrow.r.bar"), ("uparrow", "↑", "arrow.t"), ("downarrow", "↓", "arrow.b"), ("iff", "⟺", "arrow.l.r.double.long"), ("implies", "⟹", "arrow.r.double.long"),
    ("infty", "∞", "infinity"), ("partial", "∂", "diff"), ("nabla", "∇", "nabla"), ("forall", "∀", "forall"), ("exists", "∃", "exists"), ("emptyset", "∅", "emptyset"), ("ell", "ℓ", "ell"), ("hbar", "ℏ", "planck.reduce"),
    ("Re", "ℜ", "Re"), ("Im", "ℑ", "Im"), ("aleph", "ℵ", "aleph"), ("angle", "∠", "angle"), ("triangle", "△", "triangle.t"), ("prime", "′", "prime"), ("dots", "…", "dots.h"), ("ldots", "…", "dots.h"),
    ("cdots", "⋯", "dots.c"), ("vdots", "⋮", "dots.v"), ("ddots", "⋱", "dots.down"), ("langle", "⟨", "angle.l"), ("rangle", "⟩", "angle.r"), ("lfloor", "⌊", "floor.l"), ("rfloor", "⌋", "floor.r"),
    ("lceil", "⌈", "ceil.l"), ("rceil", "⌉", "ceil.r"), ("Vert", "‖", "bar.v.double"), ("dagger", "†", "dagger"), ("bullet", "∙", "bullet"), ("checkmark", "✓", "checkmark"),
    ("varepsilon", "ϵ", "epsilon.alt"), ("vartheta", "ϑ", "theta.alt"), ("varphi", "ϕ", "phi.alt"), ("varrho", "ϱ", "rho.alt"), ("varsigma", "ς", "sigma.alt"),
)
FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln lg exp lim limsup liminf max min sup inf det dim ker gcd deg arg Pr hom mod".split()
#: Accent (LaTeX), its combining or spacing character, Typst name.
ACCENTS = (("hat", "^", "hat"), ("bar", "¯", "macron"), ("tilde", "~", "tilde"), ("vec", "→", "arrow"), ("dot", "˙", "dot"), ("ddot", "¨", "dot.double"), ("check", "ˇ", "caron"), ("breve", "˘", "breve"), ("acute", "´", "acute"), ("grave", "`", "grave"))
#: Font command, MathML variant, OMML script or style, Typst call.
FONTS = (("mathbf", "bold", "b", "bold"), ("mathit", "italic", "i", "italic"), ("mathrm", "normal", "p", "upright"), ("mathbb", "double-struck", "double-struck", "bb"), ("mathcal", "script", "script", "cal"), ("mathfrak", "fraktur", "fraktur", "frak"), ("mathsf", "sans-serif", "sans-serif", "sans"), ("mathtt", "monospace", "monospace", "mono"), ("boldsymbol", "bold-italic", "bi", "bold"))
#: Colour names and their hexadecimal values.
COLORS = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "magenta": "FF00FF", "gray": "808080", "orange": "FFA500", "purple": "800080", "brown": "A52A2A", "pink": "FFC0CB", "teal": "008080", "violet": "EE82EE", "olive": "808000", "lime": "00FF00"}


def greek() -> list[tuple[str, str, str]]:
    return [(n, _lookup(n), n) for n in [*_GREEK, "lambda", *_GREEK_CAPITAL, "Lambda"]]


def _lookup(name: str) -> str:
    own = {"lambda": "lamda"}.get(name.lower(), name.lower())
    return unicodedata.lookup("GREEK " + ("CAPITAL" if name[0].isupper() else "SMALL") + " LETTER " + own.upper())


def rows() -> list[tuple[str, str, str, str]]:
    """(latex, character, typst, class)."""
    groups = (("greek", greek()), ("operator", OPERATORS), ("relation", RELATIONS), ("sign", SIGNS))
    return [("\\" + n, c, t, kind) for kind, table in groups for n, c, t in table]


UNICODE = {n[1:]: c for n, c, _, _ in rows()}
TYPST = {n[1:]: t for n, _, t, _ in rows()}
CLASS = {n[1:]: k for n, _, _, k in rows()}
FROM_UNICODE = {c: n for n, c in reversed(UNICODE.items())}
FROM_TYPST = {t: n for n, t in reversed(TYPST.items())}


def color_hex(name: str) -> str:
    """Six hexadecimal digits of a colour's name or code; black if it is neither."""
    bare = name.strip().removeprefix("#")
    if len(bare) == 6 and all(c in "0123456789abcdefABCDEF" for c in bare):
        return bare.upper()
    return COLORS.get(bare.lower(), COLORS["black"])
