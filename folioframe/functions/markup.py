"""Quality checks, repair and spacing of LaTeX and recognised text, as column functions.

None of the checks runs Python: they are Java regular expressions and array folds. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ("duplicate_relation", "repeated_token_run", "unbalanced_group", "mismatched_environment", "unbalanced_left_right")
LONG_RUN = 8


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def duplicate_relation(text: Column) -> Column:
    """Two equals signs without a backslash before them."""
    return text.rlike(r"(?<!\\)==")


def group_balance(text: Column) -> Column:
    """Unescaped opening braces less closing ones."""
    bare = F.regexp_replace(text, r"\\[\\{}]", "")
    return _count(bare, r"\{") - _count(bare, r"\}")


def left_right_balance(text: Column) -> Column:
    r"""\left less \right, where no letter follows."""
    return _count(text, r"\\left(?![A-Za-z])") - _count(text, r"\\right(?![A-Za-z])")


def environments_balanced(text: Column) -> Column:
    r"""Every \end closes the last open \begin, and none stays open: a fold with a stack."""
    marks = F.regexp_extract_all(text, F.lit(r"\\(?:begin|end)\{[^}]*\}"), F.lit(0))
    name = lambda m: F.regexp_extract(m, r"\{([^}]*)\}", 1)
    top = lambda s: F.element_at(s, -1)

    def step(stack: Column, mark: Column) -> Column:
        closes = (F.size(stack) > 1) & (top(stack) == name(mark))
        return F.when(mark.startswith("\\begin"), F.concat(stack, F.array(name(mark)))).when(closes, F.slice(stack, 1, F.size(stack) - 1)).otherwise(F.concat(stack, F.array(F.lit("!"))))

    return F.size(F.aggregate(marks, F.array(F.lit("")), step)) == 1


def repeated_token_run(text: Column, run: int = LONG_RUN) -> Column:
    """One token (a command, a run of letters and digits, or a sign) so many times in a row: a fold over tokens."""
    tokens = F.regexp_extract_all(text, F.lit(r"\\[A-Za-z]+|[\p{L}\p{N}]+|[^\s]"), F.lit(0))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a: Column, t: Column) -> Column:
        n = F.when(a["last"] == t, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    return F.aggregate(tokens, start, step)["most"] >= run


def quality_flags(text: Column) -> Column:
    """Names of the checks that fail, in the order of FLAGS."""
    t = F.trim(text)
    failed = (duplicate_relation(t), repeated_token_run(t), group_balance(t) != 0, ~environments_balanced(t), left_right_balance(t) != 0)
    return F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in zip(failed, FLAGS, strict=True)]))


def severe(flags: Column) -> Column:
    """Any flag but the unbalanced delimiters."""
    return F.exists(flags, lambda f: f != FLAGS[-1])


def close_groups(text: Column) -> Column:
    return F.concat(text, F.repeat(F.lit("}"), F.greatest(group_balance(text), F.lit(0))))


def drop_unbalanced_delimiters(text: Column) -> Column:
    return F.when(left_right_balance(text) != 0, F.regexp_replace(text, r"\\(?:left|right)(?![A-Za-z])", "")).otherwise(text)


def space_alignment(text: Column) -> Column:
    r"""Unescaped & (an even run of backslashes before it) outside environments become \quad; inside they stay."""
    spaced = lambda t: F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)&", r"$1\\quad ")
    inside = r"(?s)^(.*?)(\\begin\{.*\\end\{[^}]*\}|\\begin\{.*)(.*)$"
    part = lambda i: F.regexp_extract(text, inside, i)
    return F.when(text.contains("\\begin{"), F.concat(spaced(part(1)), part(2), spaced(part(3)))).otherwise(spaced(text))


def _chained(text: Column, mark: str) -> Column:
    """x^a^b^c becomes {{x^a}^b}^c: all but the last script are grouped with what is before."""
    script = mark + r"(?:\{[^{}]*\}|[A-Za-z0-9])"
    chain = rf"[A-Za-z0-9](?:{script}){{2,}}"
    parts = lambda c: F.regexp_extract_all(c, F.lit(script), F.lit(0))
    nested = lambda c: F.concat(F.repeat(F.lit("{"), F.size(parts(c)) - 1), F.substring(c, 1, 1), F.array_join(parts(c), "}"))
    found = F.transform(F.regexp_extract_all(text, F.lit(chain), F.lit(0)), nested)
    return F.array_join(F.zip_with(F.split(text, chain), F.concat(found, F.array(F.lit(""))), lambda before, c: F.concat(before, c)), "")


def split_double_scripts(text: Column) -> Column:
    """x^a^b becomes {x^a}^b, for plain and braced arguments and chains of any length; adjacent marks (x^^2) become one."""
    return _chained(_chained(F.regexp_replace(text, r"([\^_])[\^_]+", "$1"), r"\^"), "_")


def fill_fractions(text: Column, compat: bool = False) -> Column:
    r"""A \frac whose numerator is missing gets an empty one; compat: every \frac{ does."""
    return F.regexp_replace(text, r"\\frac\{" if compat else r"\\frac\{(?=[^{}]*\}\s*(?:$|[^{\s]))", r"\\frac{}{")


def delimit(text: Column) -> Column:
    return F.when(text.startswith("$"), text).otherwise(F.concat(F.lit("$$ "), text, F.lit(" $$")))


def repair(text: Column, compat: bool = False) -> Column:
    """All repairs in turn: groups, delimiters, alignment, scripts, fractions, dollar signs."""
    out = F.trim(text)
    for fix in (close_groups, drop_unbalanced_delimiters, space_alignment, split_double_scripts):
        out = fix(out)
    return delimit(fill_fractions(out, compat))


_HAN = r"\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF"


def insert_spaces(text: Column) -> Column:
    """Spaces where Latin and Han letters meet, after punctuation before either, and between Latin letters and brackets."""
    latin, han = "A-Za-z0-9", _HAN
    places = [f"(?<=[{latin}])(?=[{han}])", f"(?<=[{han}])(?=[{latin}])", f"(?<=[.,;:!?])(?=[{latin}](?![.,]))", f"(?<=[.,;:!?])(?=[{han}])", f"(?<=[{latin}])(?=[()\\[\\]])"]
    return F.regexp_replace(text, "|".join(places), " ")


def xml_escape(text: Column, apostrophe: bool = False) -> Column:
    out = text
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&apos;")] if apostrophe else [])):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out
