import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.functions import formulas as f
from folioframe.functions import symbols

CASES = [
    r"\frac{m-1}{2p}", r"t^5_j", r"\sqrt[4]{u+7}", r"\prod_{r=2}^{q} r", r"\beta + \Delta \geq \partial", r"\left[ \frac{3}{w} \right]", r"\begin{bmatrix} 5 & z \\ 0 & 8 \end{bmatrix}",
    r"\begin{cases} p & d \\ h & e \end{cases}", r"\tilde{g} + \mathbf{s}", r"\binom{m}{3}", r"\cos h + \tanh k", r"\text{for all } d", r"\overline{pq}", r"\textcolor{blue}{m}", r"\mu \subset \emptyset",
    r"\overbrace{r+s}^{t}", r"\underbrace{r+s}_{t}", r"\underbrace{k}", r"\overset{d}{=}", r"\cancel{7w}",
]


@pytest.mark.parametrize("text", CASES)
def test_latex_is_stable(text):
    once = f.to_latex(f.from_latex(text))
    assert f.to_latex(f.from_latex(once)) == once


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("through", ["mathml", "omml"])
def test_round_trips_keep_the_tree(text, through):
    tree = f.from_latex(text)
    made = f.WRITERS[through](tree, True)
    ET.fromstring(made)
    back = f.to_latex(f.READERS[through](made))
    if "textcolor" not in text:
        assert back == f.to_latex(tree)


def test_exact_outputs():
    assert f.to_typst(f.from_latex(r"\frac{a}{b}")) == "frac(a, b)"
    assert f.to_typst(f.from_latex(r"x^{2}")) == "x^(2)"
    assert f.to_typst(f.from_latex(r"\hat{x}")) == "hat x"
    assert f.to_typst(f.from_latex(r"\infty")) == "infinity"
    assert f.to_mathml(f.from_latex("x^2")) == '<math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><msup><mi>x</mi><mn>2</mn></msup></math>'
    assert "<m:f><m:num>" in f.to_omml(f.from_latex(r"\frac{1}{2}")) and "\\" not in f.to_omml(f.from_latex(r"\sinh x \supset y"))
    assert f.to_latex(f.from_typst("frac(a, b) + sqrt(x) + root(3, y)")) == r"\frac{a}{b} + \sqrt{x} + \sqrt[3]{y}"
    assert f.to_latex(f.from_typst("infinity in RR")) == r"\infty \in \mathbb{R}"
    assert f.to_latex(f.from_typst("mat(1, 2; 3, 4)")) == r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}"
    assert f.to_latex(f.from_mathml("<math><mfrac><mi>a</mi><mn>2</mn></mfrac></math>")) == r"\frac{a}{2}"
    assert f.to_latex(f.from_omml("<m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>")) == "x^{2}"


@pytest.mark.parametrize("bad", ["", "<math>", "<!DOCTYPE a [<!ENTITY x 'y'>]><math/>", "<m:oMath>"])
def test_bad_xml_is_an_error(bad):
    with pytest.raises(f.FormulaError):
        (f.from_omml if bad.startswith("<m:") else f.from_mathml)(bad)


@settings(max_examples=300, deadline=None)
@given(st.text(r"\{}^_&$ab1 frcsqtleigh[]()", max_size=40))
def test_any_text_ends(text):
    tree = f.from_latex(text)
    ET.fromstring(f.to_mathml(tree))
    ET.fromstring(f.to_omml(tree))
    f.to_typst(tree)
    f.from_typst(text)
    assert f.nodes(tree)[0][1] is None


def test_deep_text_is_refused():
    with pytest.raises(f.FormulaError):
        f.from_latex("{" * 1000)


def test_symbols():
    assert symbols.UNICODE["lambda"] == "λ" and symbols.UNICODE["Omega"] == "Ω" and symbols.color_hex("#00ff00") == "00FF00" and symbols.color_hex("none") == "000000"
    assert len({n for n, *_ in symbols.rows()}) == len(symbols.rows())


@pytest.mark.parametrize("text", [r"\overbrace{r+s}^{t}", r"\underset{n}{=}", r"\cancel{7w}", r"\underbrace{k}"])
def test_typst_keeps_braces_stacks_and_strikes(text):
    assert f.to_latex(f.from_typst(f.to_typst(f.from_latex(text)))) == f.to_latex(f.from_latex(text))


def test_bare_arguments_and_limits():
    assert f.to_latex(f.from_latex(r"\frac12 + \dfrac3x")) == r"\frac{1}{2} + \frac{3}{x}"
    assert f.to_latex(f.from_latex(r"\sum\limits_{i=1}^n i")) == f.to_latex(f.from_latex(r"\sum_{i=1}^n i"))
    assert f.to_latex(f.from_latex(r"\stackrel{d}{=}")) == r"\overset{d}{=}"


def test_brace_with_a_note_is_a_bar_in_omml():
    assert all("<m:bar>" in f.to_omml(f.from_latex(x)) for x in (r"\overbrace{a+b}^{c}", r"\underbrace{a+b}_{c}"))


def test_mathml_elements():
    read = lambda x: f.to_latex(f.from_mathml(f"<math>{x}</math>"))
    assert read('<mfenced open="[" close=")"><mi>a</mi><mi>b</mi></mfenced>') == r"\left[ a , b \right)"
    assert read('<menclose notation="radical"><mi>a</mi></menclose>') == r"\sqrt{a}"
    assert read("<mmultiscripts><mi>X</mi><mi>a</mi><mi>b</mi><mprescripts/><mi>c</mi><none/></mmultiscripts>") == "{}_{c} X_{a}^{b}"
    assert read("<mi>&alpha;</mi><mo>&le;</mo><mn>2</mn>") == r"\alpha \leq 2"


def test_omml_elements():
    run = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
    read = lambda x: f.to_latex(f.from_omml(f"<m:oMath>{x}</m:oMath>"))
    assert read(f"<m:sPre><m:sub>{run(1)}</m:sub><m:sup>{run(2)}</m:sup><m:e>{run('X')}</m:e></m:sPre>") == "{}_{1}^{2} X"
    assert read(f"<m:limLow><m:e>{run('lim')}</m:e><m:lim>{run('n')}</m:lim></m:limLow>") == r"\lim_{n}"
    assert read(f"<m:limUpp><m:e>{run('=')}</m:e><m:lim>{run('d')}</m:lim></m:limUpp>") == r"\overset{d}{=}"
