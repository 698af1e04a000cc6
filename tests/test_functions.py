"""Pure scanners, the HTML tree and number words."""

import random

import pytest

from pyspark.sql import functions as F

from treerow.functions import markup, numerals
from treerow.sources import html


def test_direct_text():
    s = "a <b>b</b><!-- x --><div>c<i>d</i></div><br>e &amp; <p title='>'>f</p>"
    assert markup.direct_text(s) == "a be &amp; "
    assert markup.direct_text(s, strict=True) == "a e &amp; "
    assert markup.direct_text("a <b") == "a "


def test_limit_html():
    s = "x<span>y<b>z</b></span><!--c--><br>"
    assert markup.limit_html(s, 1) == "x<span>yz</span><!--c--><br>"
    assert markup.limit_html(s, 0) == "xyz<!--c-->"
    assert markup.limit_html(s, 2) == s
    assert markup.limit_html("a<b", 0) == "a<b"


def test_minify_html():
    assert markup.minify_html("<pre>\n a  b\n</pre><div>\n x   y\n</div>") == "<pre>\n a  b\n</pre><div> x y </div>"
    assert markup.minify_html("<b> a </b>  <i>b</i> \n") == "<b> a </b><i>b</i>"
    assert markup.minify_html("  a  b  ") == " a b "
    for body in ("if (i<n) { j  ++ }", "  x<y && y>z  ", "'</p>'  +  1", "</scripted>  k"):
        assert markup.minify_html(f"<script>{body}</script><em>  q   r </em>") == f"<script>{body}</script><em> q r </em>"
    assert markup.minify_html("<style>  u < v ") == "<style>  u < v "
    assert markup.minify_html("<pre> 1 <b>  2</b></PRE >  <u>  3</u>") == "<pre> 1 <b>  2</b></PRE ><u> 3</u>"


def tree(*parts):
    return [(e.id, e.tag, None if e.parent is None else e.parent.id) for e in html.parse(list(parts))]


def test_tree_repairs():
    assert tree("<div><p>Hi") == [(0, "div", None), (1, "p", 0)]
    assert tree("<p><b>x<br><p>y</article>z") == [(0, "p", None), (1, "b", 0), (2, "br", 1), (3, "p", None)]
    assert tree("<ul><li>a<li>b<ul><li>c</ul></ul>") == [(0, "ul", None), (1, "li", 0), (2, "li", 0), (3, "ul", 2), (4, "li", 3)]
    assert tree("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table></table>")[1:6] == [(1, "tr", 0), (2, "td", 1), (3, "td", 1), (4, "tr", 0), (5, "td", 4)]
    assert tree("<div><span>Title</div><i></i>") == [(0, "div", None), (1, "span", 0), (2, "i", None)]
    assert tree("", None, "\xff\xfe<", "<a/><!doctype x><!-- <b> --><c></c>") == [(0, "a", None), (1, "c", None)]


def test_tree_values():
    e, *rest = html.parse(["<DIV Id=a CLASS='x y' hidden id=b>1 &lt; 2<script>if (a<b) {}</script><br><!--c--><a href='?a=1&amp;b=\"'>t</a></DIV>"])
    assert e.attributes == {"id": "a", "class": "x y", "hidden": ""}
    assert html.text(e) == "1 < 2if (a<b) {}t"
    assert html.inner_html(e) == '1 &lt; 2<script>if (a<b) {}</script><br><!--c--><a href="?a=1&amp;b=&quot;">t</a>'
    assert (e.end, e.height, [r.position for r in rest]) == (3, 1, [1, 2, 3])
    deep = html.parse(["<div>" * 5000 + "x"])
    assert html.text(deep[0]) == "x" and deep[0].height == 4999


def test_direct_text_of_a_tree_is_that_of_its_markup():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice(["<div>", "</div>", "<b>", "</b>", "<br>", "x ", "&amp;", "<!--c-->", "<p>", "</p>", "<span>", "</span>"]) for _ in range(25))
        for e in html.parse([f"<main>{s}</main>"]):
            inner = html.inner_html(e)
            assert html.direct_text(e) == markup.direct_text(inner)
            assert html.direct_text(e, strict=True) == markup.direct_text(inner, strict=True)


def test_grid():
    (e, *_) = html.parse(["<table><tr><th> H </th></tr><tr></tr><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>"])
    assert html.grid(e) == [["H"], ["ab", "c"]]


@pytest.mark.parametrize(
    ("number", "words"),
    [("0", "សូន្យ"), ("15", "ដប់-ប្រាំ"), ("105", "មួយ-រយ-ប្រាំ"), ("12345", "មួយ-ម៉ឺន-ពីរ-ពាន់-បី-រយ-សែសិប-ប្រាំ"), ("1000001", "មួយ-លាន-មួយ"), ("12.30", "ដប់-ពីរ-ក្បៀស-បី-សូន្យ"), ("-100.50", "ដក-មួយ-រយ-ក្បៀស-ប្រាំ-សូន្យ")],
)
def test_number_words(number, words):
    assert numerals.to_words(number) == words
    assert numerals.from_words(words) == number
    assert numerals.from_words(words.replace("-", "")) == number


def test_numbers_round_trip():
    rng = random.Random(1337)
    for _ in range(1000):
        n = rng.choice(["", "-"]) + str(rng.getrandbits(rng.randint(1, 100))) + rng.choice(["", f".{rng.randint(0, 999):03d}"])
        n = "0" if n == "-0" else n
        assert numerals.from_words(numerals.to_words(n)) == n
    assert numerals.to_numerals("-12.5") == "-១២.៥"


def test_bad_number_words():
    for text in ("", "abc", "រយ", "មួយ-ពីរ", "លាន"):
        with pytest.raises(numerals.NumeralError):
            numerals.from_words(text)
    with pytest.raises(numerals.NumeralError, match="did you mean"):
        numerals.from_words("មួ")
    with pytest.raises(numerals.NumeralError):
        numerals.to_words("1x")


def test_stripped_names_and_end_tags(spark):
    from treerow.functions.text import strip_html

    made = ["a<scripts>b</scripts>c</script>d", "a<STYLE>b</style >c</Style>d", "<noscript>x", "k<!-- <b> -->l<i>m</i>", "n<o"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i long, s string").orderBy("i").select(strip_html(F.col("s"))).collect()]
    assert got == ["ad", "ad", "", "klm", "n"]
