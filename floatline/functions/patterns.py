"""The extraction rules a prospectus is read with.

FIXED VALUES — these must equal the tracked behaviour exactly, so they are
stated here as plain text, in their natural order, together.  The patterns
are written in Python ``re`` syntax as published; ``java_pattern`` below turns
each into the form Spark (java.util.regex) and the DuckDB oracle (RE2) need,
and every change it makes is listed there.
"""

from __future__ import annotations

# ── FIXED VALUES: offer price, first matching pattern wins ────────────────────
OFFER_PRICE = [
    r"offering\s+price\s+per\s+share[^.]{0,150}\$\s*([\d,]+(?:\.\d+)?)",
    r"price\s+to\s+(?:the\s+)?public[^.]{0,120}\$\s*([\d,]+(?:\.\d+)?)",
    r"at\s+\$\s*([\d,]+(?:\.\d+)?)\s+per\s+share",
    r"per\s+share\s+(?:price\s+)?of\s+\$\s*([\d,]+(?:\.\d+)?)",
]

# ── FIXED VALUES: price range, both groups from the first matching pattern ────
PRICE_RANGE = [
    r"\$\s*([\d,]+(?:\.\d+)?)\s+to\s+\$\s*([\d,]+(?:\.\d+)?)\s+per\s+share",
    r"between\s+\$\s*([\d,]+(?:\.\d+)?)\s+and\s+\$\s*([\d,]+(?:\.\d+)?)",
    r"price\s+range[^.]{0,80}\$\s*([\d,]+(?:\.\d+)?)\s*[-–to]+\s*\$\s*([\d,]+(?:\.\d+)?)",
]

# ── FIXED VALUES: total shares offered ────────────────────────────────────────
SHARES_OFFERED_TOTAL = [
    r"(\d[\d,]+)\s+shares[^.]{0,60}offered\s+by\s+this\s+prospectus",
    r"total\s+of\s+(\d[\d,]+)\s+shares[^.]{0,80}(?:this\s+offering|offered)",
    r"(?<!aggregate\s)offering\s+of\s+(\d[\d,]+)\s+shares\s+of",
    r"[\w\s,\.]+(?:Inc\.|Corp\.|Ltd\.|LLC|L\.P\.)\s+is\s+offering\s+(\d[\d,]+)\s+shares\s+of\s+its",
    r"(?:we|the\s+company)\s+(?:are|is)\s+offering\s+(\d[\d,]+)\s+shares",
]

# ── FIXED VALUES: shares offered by the company (primary) ─────────────────────
SHARES_PRIMARY = [
    r"[\w\s,\.]+(?:Inc\.|Corp\.|Ltd\.|LLC|L\.P\.)\s+is\s+offering\s+(\d[\d,]+)\s+shares",
    r"(?:we|the\s+company)\s+(?:are|is)\s+offering\s+(\d[\d,]+)\s+shares",
    r"(\d[\d,]+)\s+shares\s+(?:of\s+(?:our|its)\s+(?:Class\s+[A-C]\s+)?common\s+stock\s+)?(?:are\s+being\s+)?offered\s+by\s+us",
]

# ── FIXED VALUES: shares offered by selling holders (secondary) ───────────────
SHARES_SECONDARY = [
    r"selling\s+stockholders?[^.]{0,120}(?:are\s+)?offering\s+(?:an\s+aggregate\s+of\s+)?(\d[\d,]+)\s+shares",
    r"(\d[\d,]+)\s+shares[^.]{0,80}selling\s+stockholders?\s+(?:identified|named|listed)",
    r"selling\s+shareholders?[^.]{0,120}(?:are\s+)?offering\s+(?:an\s+aggregate\s+of\s+)?(\d[\d,]+)\s+shares",
]

# ── FIXED VALUES: over-allotment (greenshoe) shares ───────────────────────────
GREENSHOE = [
    r"(\d[\d,]+)\s+(?:additional\s+)?shares?[^.]{0,120}to\s+cover\s+over.?allotment",
    r"over.?allotment\s+option[^.]{0,120}(?:to\s+purchase|of|for)\s+(?:up\s+to\s+)?(\d[\d,]+)\s+(?:additional\s+)?shares",
    r"purchase\s+(?:up\s+to\s+)?(\d[\d,]+)\s+additional\s+shares?[^.]{0,80}over.?allotment",
    r"grant(?:ed)?\s+the\s+underwriters?\s+(?:an?\s+)?option\s+to\s+purchase[^.]{0,60}(\d[\d,]+)\s+(?:additional\s+)?shares",
]

# ── FIXED VALUES: bookrunner block on the cover page, and its fallback ────────
BOOKRUNNER_BLOCK = (
    r"(?:deliver\s+the\s+shares\s+against\s+payment[^\n]*\n"
    r"|The\s+underwriters\s+expect\s+to\s+deliver[^\n]*\n)"
    r"((?:[^\n]+\n){1,40}?)"
    r"(?:Prospectus\s+dated|Table\s+of\s+Contents|_{4,})"
)
BOOKRUNNER_FALLBACK = (
    r"(?:Joint\s+)?Book.?Running\s+Managers?\s*\n((?:[^\n]+\n){1,20}?)(?:\n\n|\Z)"
)
# A block line is dropped when it matches this (anchored at the line start).
BOOKRUNNER_SKIP_LINE = r"^[\d_\-\.\*]+$|^In\s+alphabetical|^Prospectus|^\*"
BOOKRUNNER_MIN_LEN = 3
BOOKRUNNER_SEPARATOR = "; "

# ── FIXED VALUES: post-offering shares outstanding ────────────────────────────
# Tier 1: first match wins.
POST_IPO_TIER1 = [
    r"Class\s+[A-C](?:(?:,|\s+and)\s+Class\s+[A-C])+\s+common\s+stock\s+"
    r"to\s+be\s+outstanding\s+(?:immediately\s+)?after\s+this\s+offering\s*\n\s*([\d,]+)",
    r"total\s+(?:of\s+)?(\d[\d,]+)\s+shares?[^.]{0,80}"
    r"outstanding\s+(?:immediately\s+)?after\s+(?:this\s+)?offering",
]
# Tier 2: the largest value over all matches of both patterns.
POST_IPO_TIER2 = [
    r"(\d[\d,]+)\s+shares?[^.]{0,200}"
    r"outstanding\s+(?:immediately\s+)?after\s+(?:this\s+)?offering",
    r"outstanding\s+(?:immediately\s+)?after\s+this\s+offering\s*\n\s*([\d,]+)",
]

# ── FIXED VALUES: pre-offering shares outstanding ─────────────────────────────
PRE_IPO = [
    r"(\d[\d,]+)\s+shares?\s+of\s+(?:our\s+)?common\s+stock\s+outstanding\s+as\s+of",
    r"(\d[\d,]+)\s+shares?\s+(?:of\s+\w+\s+)?outstanding\s+as\s+of[^.]{0,80}prior\s+to",
    r"(\d[\d,]+)\s+shares?[^.]{0,80}were\s+outstanding\s+(?:as\s+of|on)",
]

# ── FIXED VALUES: fully diluted shares ────────────────────────────────────────
FULLY_DILUTED = [
    r"(\d[\d,]+)\s+shares?[^.]{0,80}(?:fully\s+diluted|fully-diluted)\s+basis",
    r"on\s+a\s+(?:fully\s+diluted|fully-diluted)\s+basis[^.]{0,80}(\d[\d,]+)\s+shares?",
    r"total\s+shares?\s+(?:of\s+common\s+stock\s+)?outstanding[^.]{0,60}(\d[\d,]+)",
]

# ── FIXED VALUES: number scale words ──────────────────────────────────────────
SCALE_BILLION = ("billion", 1_000_000_000.0)
SCALE_MILLION = ("million", 1_000_000.0)

# ── FIXED VALUES: lock-up section titles (priority order) and window ──────────
LOCKUP_SECTION_TITLES = [
    "lock-up agreements",
    "lock-up",
    "lockup agreements",
    "lockup",
    "market standoff",
    "shares eligible for future sale",
    "underwriting",
]
LOCKUP_SECTION_CHARS = 6000

# ── FIXED VALUES: lock-up day counts (all matches of all patterns vote) ───────
LOCKUP_DAYS = [
    r"for\s+a\s+period\s+of\s+(\d+)\s+days?\s+(?:after|following|from)",
    r"for\s+(\d+)\s+days?\s+(?:after|following|from)",
    r"beginning\s+(\d+)\s+days?\s+(?:after|following|from)",
    r"(\d+)[- ]day\s+(?:lock[- ]?up|restricted|restriction)\s+period",
    r"lock[- ]?up\s+period\s+of\s+(\d+)\s+days?",
    r"not\s+to\s+(?:sell|offer|transfer|dispose)\b.{0,80}?for\s+(\d+)\s+days?",
]
# Only the last pattern above is read with "." matching newlines.
LOCKUP_DAYS_DOTALL = [False, False, False, False, False, True]
LOCKUP_DAYS_MIN = 30
LOCKUP_DAYS_MAX = 730

# ── FIXED VALUES: staged-unlock language (any match in the section) ───────────
STAGED_UNLOCK = [
    r"\d+\s*%\s+(?:of\s+(?:the\s+)?(?:shares|securities|stock))?\s*(?:will\s+be\s+)?released",
    r"at\s+the\s+beginning\s+of\s+each\s+\d+[- ]day\s+period",
    r"release[sd]?\s+in\s+(?:tranches?|installments?|stages?|portions?)",
    r"(?:pro[- ]?rata|ratable|ratably)\s+(?:over|during|throughout)",
    r"(?:quarterly|monthly|annually|semi[- ]?annually)\s+(?:vest|release|unlock)",
    r"earnings[- ]related\s+release",
    r"performance[- ](?:based|related)\s+(?:release|unlock|vesting)",
    r"multi[- ]?(?:stage|tranche|tier)\s+(?:release|unlock|lock[- ]?up)",
    r"subject\s+to\s+certain\s+exceptions.*?\breleased?\b",
    r"first\s+\d+\s+days?\s+.{0,60}?\s+next\s+\d+\s+days?",
]
STAGED_UNLOCK_DOTALL = [False] * 8 + [True, True]

# ── FIXED VALUES: unlock-note sentences (first match of each, in order) ───────
UNLOCK_NOTES = [
    r"for\s+(?:a\s+period\s+of\s+)?\d+\s+days?\s+(?:after|following|from)[^.]{0,200}\.",
    r"\d+[- ]day\s+(?:lock[- ]?up|restricted)\s+period[^.]{0,200}\.",
    r"\d+\s*%\s+(?:of\s+the\s+shares?\s+)?(?:will\s+be\s+)?released[^.]{0,200}\.",
]
UNLOCK_NOTES_MAX_NOTES = 2
UNLOCK_NOTES_JOIN = " | "
UNLOCK_NOTES_MAX_CHARS = 300

# ── FIXED VALUES: confidence ──────────────────────────────────────────────────
STANDARD_LOCKUP_DAYS = [90, 180, 360]

# ── FIXED VALUES: generic section finder ──────────────────────────────────────
SECTION_WINDOW_CHARS = 8000
SECTION_BOUNDARY = r"^(?:[A-Z][A-Z\s\-,&]{4,}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,6})\s*$"
# The boundary is only tested from this line index on (the title line is 0).
SECTION_BOUNDARY_FROM_LINE = 3


# ── Dialect adaptation ────────────────────────────────────────────────────────
# The heavy "<name> Inc. is offering" patterns backtrack quadratically in a
# backtracking engine when a long run of word characters has no match.  A
# match can only start where such a run starts, and from the run start greed
# reaches the same (last) phrase, so anchoring the start at a run boundary
# gives the same capture in linear time.
_RUN_CLASS = r"[\w\s,\.]+"
_RUN_START = r"(?<![\w\s,\.])"
# Likewise a pattern opening with a digit run ("\d[\d,]+" or "\d+") can only
# have its leftmost match at a position not preceded by a digit (one digit
# earlier would match too), so other starts are skipped.
_DIGIT_OPENERS = (r"(\d[\d,]+)", r"(\d+)", r"\d+")
_DIGIT_START = r"(?<!\d)"


def java_pattern(py: str, *, dotall: bool, case_insensitive: bool = True) -> str:
    """Python ``re`` pattern -> java.util.regex pattern with equal matches.

    * ``(?U)`` makes ``\\s``/``\\w``/``\\d`` Unicode-aware, as in Python 3.
    * ``\\Z`` (Python: end of text) is ``\\z`` in Java.
    * run-start / digit-run-start anchors (see above): same leftmost match,
      fewer start positions tried.
    """
    flags = "(?" + ("i" if case_insensitive else "") + ("s" if dotall else "") + "U)"
    body = py.replace(r"\Z", r"\z")
    if body.startswith(_RUN_CLASS):
        body = _RUN_START + body
    elif body.startswith(_DIGIT_OPENERS):
        body = _DIGIT_START + body
    return flags + body


def re2_pattern(py: str) -> str:
    """Python pattern -> RE2 (DuckDB oracle).  RE2 has no look-behind; it is
    linear already, so the only look-behind rule (aggregate offering) is
    dropped and fixtures keep "aggregate offering of" out of their text."""
    return py.replace(r"(?<!aggregate\s)", "").replace(r"\Z", r"\z")
