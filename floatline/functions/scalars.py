"""Scalar column functions (no UDFs): numbers, identifiers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floatline.functions import patterns as P

# Python's whitespace set (str.isspace): Unicode White_Space plus the four
# information separators.  Written as an explicit class so Spark (Java) and
# the DuckDB oracle (RE2) strip exactly the same characters.
PY_WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WS_NO_NL = PY_WS.replace(r"\n", "")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: both ends, every whitespace character."""
    return F.regexp_replace(col_of(c), rf"^[{PY_WS}]+|[{PY_WS}]+\z", "")


def blank_to_null(c) -> Column:
    """trimmed text, or null when nothing is left."""
    s = py_strip(c)
    return F.when(s != "", s)


NUMERIC_TEXT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def parse_number(raw) -> Column:
    """"15,276,527" -> 15276527.0; "20.2 million" -> 20200000.0; else null.

    ``billion`` is checked before ``million``; only the matched word is
    removed, so text holding both does not parse.
    """
    raw = col_of(raw)
    s = py_strip(raw)
    low = F.lower(s)
    (bw, bm), (mw, mm) = P.SCALE_BILLION, P.SCALE_MILLION
    has_b = low.contains(bw)
    has_m = low.contains(mw)
    body = (F.when(has_b, F.regexp_replace(s, rf"(?iU)\s*{bw}", ""))
            .when(has_m, F.regexp_replace(s, rf"(?iU)\s*{mw}", ""))
            .otherwise(s))
    text = py_strip(F.replace(body, F.lit(","), F.lit("")))
    # Java also reads "12d" and "0x1p3" as numbers
    value = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    mult = F.when(has_b, F.lit(bm)).when(has_m, F.lit(mm)).otherwise(F.lit(1.0))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("double")).otherwise(value * mult)


def normalize_cik(cik) -> Column:
    """integer CIK -> 10-digit zero-padded text (``str(int(x)).zfill(10)``);
    null when the text is not an integer."""
    n = py_strip(col_of(cik)).try_cast("bigint")
    digits = F.abs(n).cast("string")
    width = F.when(n < 0, F.lit(9)).otherwise(F.lit(10))
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return F.when(n.isNull(), F.lit(None).cast("string")).when(
        n < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data"  # FIXED VALUE


def filing_primary_doc_url(cik, accession, doc) -> Column:
    """base/int(cik)/accession-without-dashes/doc; null without both parts."""
    cik_int = py_strip(col_of(cik)).try_cast("bigint").cast("string")
    acc, doc = col_of(accession), col_of(doc)
    url = F.concat(F.lit(ARCHIVE_BASE + "/"), cik_int, F.lit("/"),
                   F.replace(acc, F.lit("-"), F.lit("")), F.lit("/"), doc)
    return F.when((F.coalesce(acc, F.lit("")) != "") & (F.coalesce(doc, F.lit("")) != ""), url)


def filing_index_url(cik, accession) -> Column:
    """base/int(cik)/accession-without-dashes/, or '' without accession."""
    cik_int = py_strip(col_of(cik)).try_cast("bigint").cast("string")
    acc = col_of(accession)
    url = F.concat(F.lit(ARCHIVE_BASE + "/"), cik_int, F.lit("/"),
                   F.replace(acc, F.lit("-"), F.lit("")), F.lit("/"))
    return F.when(F.coalesce(acc, F.lit("")) != "", F.coalesce(url, F.lit(""))).otherwise(F.lit(""))


MAX_VALID_EPOCH_MS = 4_102_444_800_000  # FIXED VALUE: 2100-01-01, TBA beyond


def epoch_ms_to_date(ms) -> Column:
    """epoch milliseconds (text or number) -> UTC date; null when not an
    integer, not positive, or past 2100-01-01."""
    n = py_strip(col_of(ms).cast("string")).try_cast("bigint")
    ok = (n > 0) & (n <= MAX_VALID_EPOCH_MS)
    return F.when(ok, F.to_date(F.timestamp_millis(n)))


# FIXED VALUES: accepted date spellings, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yyyy", "MM/dd/yyyy"]


def parse_date(s) -> Column:
    """text -> date over the fixed formats; null when none fits."""
    s = py_strip(col_of(s))
    return F.coalesce(*[F.try_to_date(s, fmt) for fmt in DATE_FORMATS])


def add_days(d, n) -> Column:
    """a date, or text that ``parse_date`` reads, plus days; null where
    either is missing or does not parse."""
    return F.date_add(parse_date(col_of(d).cast("string")), col_of(n).try_cast("int"))


def keep_new(new, old) -> Column:
    """F16: the new value wins unless it is null."""
    return F.coalesce(col_of(new), col_of(old))
