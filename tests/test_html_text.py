"""tag runs of any length, quoted attributes, references as Python decodes them."""

import html

import pytest

from floatline.functions.text import html_to_text
from tests.conftest import one_column

REFS = [
    "caf&eacute; &ensp;a&thinsp;b &dagger;&frac12;", "&copy 2020 &copyright; &notit; &notin; &nosuch;",
    "&amp;lt; &#38;gt; &ampamp;", "&#00000160;x&#x000000A0;y", "&#x80;&#150;", "&#0;&#xD800;&#99999999999;&#x110000;",
    "&#x1F600; &#128512 z", "a && b & c &; &#; &#x; &1;", "&AMP; &LT &QUOT;", "&lt;b&gt;bold&lt;/b&gt;",
]


def test_long_tag_runs(spark):
    cells = "<tr>" + "<td></td>" * 25_000 + "</tr>"
    page = "<table>" + "<tr><td> a </td></tr>\n" * 240_000 + "</table>"
    assert len(page) > 5_000_000
    got = one_column(spark, ["x" + cells + "y", page], html_to_text)
    assert got[0] == "x\ny"
    assert got[1].split() == ["a"] * 240_000


def test_references_as_the_standard_library_decodes_them(spark):
    got = one_column(spark, [f"<p>.{t}.</p>" for t in REFS], html_to_text)
    assert got == [f".{html.unescape(t)}." for t in REFS]


@pytest.mark.parametrize("raw,want", [
    ('<p title="a > b">x</p>', "x"), ("<p title='1 > 0' class=\"k\">x</p>", "x"),
    ("<p don't>x</p>y", "x\ny"), ("<a href='u\">q</a> z", "q\n z"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2")])
def test_quoted_attributes(spark, raw, want):
    assert one_column(spark, [raw], html_to_text) == [want]


def test_find_section_keeps_its_place_behind_letters_that_change_length(spark):
    """A capital I with a dot is two characters in lower case."""
    import re as _re

    from floatline.functions import text as TX

    def plain(text, titles, window):
        for title in titles:
            m = _re.search(_re.escape(title), text, _re.IGNORECASE)
            if m:
                return text[m.start():m.start() + window].strip()

    texts = ["\u0130\u0130\u0130 before. UNDERWRITING terms follow", "\U0001F600\U0001F600 x underWriting a\U0001F600b" + "y" * 50,
             "no title", "", "Risk (a+b) factors", "Under\u0130 writing", "UNDERWRIT\u0130NG or underwriting here"]
    titles = ["underwriting", "risk (A+B)"]
    got = one_column(spark, texts, lambda c: TX.find_section(c, titles, 24))
    assert got == [plain(t, titles, 24) for t in texts]
