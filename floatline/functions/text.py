"""Text functions: whitespace, HTML to text, section finders.

All are chains of built-in string/regex/array expressions, so they run inside
whole-stage codegen on the executors; no per-row Python.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from floatline.functions import patterns as P
from floatline.functions.scalars import PY_WS, PY_WS_NO_NL, col_of, py_strip


def normalize_whitespace(c) -> Column:
    """every whitespace run becomes one space; ends trimmed."""
    return py_strip(F.regexp_replace(col_of(c), rf"[{PY_WS}]+", " "))


# ── F7: HTML -> text ──────────────────────────────────────────────────────────
# Non-content elements are dropped with their content; every run of tags then
# becomes one line break, as a text-node join with "\n" would give.
DROPPED_ELEMENTS = ["script", "style", "head"]

# One tag: quoted attribute values may hold ">"; where quotes do not pair up,
# the tag ends at the first ">".
TAG = r"""<[/!?]?[A-Za-z](?:[^"'>]|"[^"<]*"|'[^'<]*')*>|<[/!?]?[A-Za-z][^>]*>"""
TAG_RUN = f"(?:{TAG})+"
# The same with possessive groups: nothing that follows could make use of a
# shorter match, and Java runs these as loops, where a plain repeated group
# recurses once per tag (a few thousand adjacent tags overflow the stack).
TAG_RUN_JAVA = r"""(?:<[/!?]?[A-Za-z](?:[^"'>]++|"[^"<]*"|'[^'<]*')*+>|<[/!?]?[A-Za-z][^>]*>)++"""


def element_pattern(name: str, flags: bool = True) -> str:
    """An element with its content; an unclosed one runs to the end."""
    return ("(?is)" if flags else "") + rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)"


# Scripts, styles and comments in one left-to-right pass: whichever starts
# first is removed whole, so a comment inside a script stays script text and
# a script inside a comment stays comment text, as in an HTML parser.
NON_CONTENT = ("(?is)" + element_pattern("script", False) + "|" + element_pattern("style", False)
               + r"|<!--.*?(?:-->|\z)")


# Character references, decoded in one pass so that nothing a reference
# produces is decoded again.  A numeric one becomes its character (code point
# 0, surrogates and values past U+10FFFF become U+FFFD), built from the code
# point with unhex + decode.  A named one is looked up in the HTML standard's
# table (the standard library has it); without a semicolon the longest name
# that may go without one counts, and the rest stays text.  The text between
# references is zipped back around them.
CHAR_REF = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
REPLACEMENT_CHAR = "\uFFFD"
NAMED_REFS = dict(html5)
BARE_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"

# FIXED VALUES (HTML standard, numeric character reference end state): code
# points 0x80-0x9F in a reference are read as Windows-1252 characters.
C1_REMAP = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020,
    0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152,
    0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def _remap_c1(n: Column) -> Column:
    out = None
    for src, dst in C1_REMAP.items():
        out = (F.when if out is None else out.when)(n == src, F.lit(dst).cast("long"))
    return out.otherwise(n)


def _named_refs() -> Column:
    """The named references as a map of maps, by their first letter: a map is
    walked from its start, so a look-up passes some tens of entries, not all."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in NAMED_REFS.items():
        by_letter.setdefault(name[0], {})[name] = value
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def decode_refs(x: Column) -> Column:
    names = _named_refs()
    look_up = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    valid = lambda n: (n >= 1) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)

    def numeric(c):
        digits = F.regexp_extract(c, "^#[xX]?0*([0-9a-fA-F]*);?$", 1)
        n = (F.when(F.length(digits) > 8, F.lit(-1).cast("long"))
             .when(digits == "", F.lit(0).cast("long"))
             .when(F.lower(F.substring(c, 2, 1)) == "x", F.conv(digits, 16, 10).try_cast("long"))
             .otherwise(digits.try_cast("long")))
        n = _remap_c1(n)
        return F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT_CHAR))

    def named(c):
        bare = F.regexp_extract(c, BARE_NAMES, 1)
        return F.coalesce(look_up(c), F.concat(look_up(bare), F.substr(c, F.length(bare) + 1)),
                          F.concat(F.lit("&"), c))

    chars = F.transform(F.regexp_extract_all(x, F.lit(CHAR_REF), F.lit(1)),
                        lambda c: F.when(F.substring(c, 1, 1) == "#", numeric(c)).otherwise(named(c)))
    pieces = F.zip_with(F.split(x, CHAR_REF), chars,
                        lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit(""))))
    return F.when(F.instr(x, "&") > 0, F.array_join(pieces, "")).otherwise(x)


def html_to_text(html) -> Column:
    """visible text of an HTML page, one text node per line.

    Steps: drop scripts, styles and comments (one pass), then head; tags ->
    line break; decode references (one pass); unify line ends; collapse 3+
    line breaks to 2; strip trailing spaces per line; strip the whole text.  Null/empty
    html -> ''.
    """
    x = F.coalesce(col_of(html), F.lit(""))
    x = F.regexp_replace(x, NON_CONTENT, "")
    x = F.regexp_replace(x, element_pattern("head"), "")
    x = F.regexp_replace(x, TAG_RUN_JAVA, "\n")
    x = decode_refs(x)
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    x = F.regexp_replace(x, rf"(?md)[{PY_WS_NO_NL}]+$", "")
    return py_strip(x)


# ── F8: generic section finder ────────────────────────────────────────────────

def _title_window(title: str, window: int) -> str:
    """Pattern of the title, whatever its case, and the characters after it that fill the window."""
    return "(?iu)" + re.escape(title) + rf"(?s:.{{0,{max(0, window - len(title))}}})"


def find_section(text, titles: list[str], window: int = P.SECTION_WINDOW_CHARS) -> Column:
    """F8: from the first title (list order) found case-insensitively, up to
    ``window`` characters, cut after the first heading-like line at index
    >= 3 (that line included); null when no title occurs."""
    t = col_of(text)
    # The title is searched in the text itself: lower case would shift what follows some characters.
    win = F.coalesce(*[F.nullif(F.regexp_extract(t, _title_window(title, window), 0), F.lit("")) for title in titles])
    lines = F.split(win, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    boundary = "(?U)" + P.SECTION_BOUNDARY
    flags = F.transform(lines, lambda line, i: (i >= P.SECTION_BOUNDARY_FROM_LINE)
                        & py_strip(line).rlike(boundary))
    cut = F.array_position(flags, True)
    kept = F.when(cut > 0, F.slice(lines, 1, cut.cast("int"))).otherwise(lines)
    return F.when(win.isNotNull(), py_strip(F.array_join(kept, "\n")))


# ── F9: lock-up section ───────────────────────────────────────────────────────

def lockup_section_start(text, low: Column | None = None) -> Column:
    """1-based start of the first lock-up title (priority order), or null; ``low``: the text in lower case, where it is at hand."""
    low = F.lower(col_of(text)) if low is None else low
    return F.coalesce(*[F.when(F.locate(title, low) > 0, F.locate(title, low))
                        for title in P.LOCKUP_SECTION_TITLES])


def lockup_section(text, start: Column | None = None) -> Column:
    """6,000 characters from the first lock-up title; whole text if none."""
    t = col_of(text)
    start = lockup_section_start(t) if start is None else start
    return F.when(start.isNotNull(), F.substring(t, start, P.LOCKUP_SECTION_CHARS)).otherwise(t)
