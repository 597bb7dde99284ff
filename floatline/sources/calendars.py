"""Listing calendars -> candidates (S1 Nasdaq-style, S2 NYSE-style).

Input is landed JSON text, one document per row; parsing is ``from_json``
with a declared schema, rows come out with ``posexplode`` (map-only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floatline.functions.scalars import blank_to_null, epoch_ms_to_date, py_strip
from floatline.operators.ranking import first_per_key
from floatline.sources.payloads import parsed, quarantine

# FIXED VALUES: source pages credited on each candidate.
NASDAQ_SOURCE_URL = "https://www.nasdaq.com/market-activity/ipos"
NYSE_SOURCE_URL = "https://www.nyse.com/ipo-center"
# FIXED VALUES: calendar sections read, in order, with their date field.
NASDAQ_SECTIONS = [("priced", "pricedDate"), ("upcoming", "expectedPriceDate"), ("filed", "filedDate")]

_S = T.StringType()
_ROW = T.StructType([T.StructField(n, _S) for n in
                     ["dealID", "companyName", "proposedTickerSymbol", "proposedExchange",
                      "pricedDate", "expectedPriceDate", "filedDate"]])
_ROWS = T.StructType([T.StructField("rows", T.ArrayType(_ROW))])
NASDAQ_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("priced", _ROWS),
    T.StructField("upcoming", T.StructType([T.StructField("upcomingTable", _ROWS)])),
    T.StructField("filed", _ROWS)]))])
NYSE_SCHEMA = T.StructType([T.StructField("calendarList", T.ArrayType(T.StructType([
    T.StructField(n, _S) for n in ["issuer_nm", "symbol", "custom_group_exchange_nm",
                                    "deal_status_flg", "price_dt", "init_file_dt"]])))])


def month_window(as_of: Column, lookback: int = 1, lookahead: int = 2) -> tuple[Column, Column]:
    """First and last 'yyyy-MM' of the months read around ``as_of``."""
    first = F.trunc(as_of, "month")
    return (F.date_format(F.add_months(first, -lookback), "yyyy-MM"),
            F.date_format(F.add_months(first, lookahead), "yyyy-MM"))


def nasdaq_rows(docs: DataFrame, as_of: Column, lookback: int = 1, lookahead: int = 2) -> DataFrame:
    """All calendar rows of the months in the window, with their read order.
    A page is parsed once; an unreadable page has no rows."""
    lo, hi = month_window(as_of, lookback, lookahead)
    paths = {"priced": "d.data.priced.rows", "upcoming": "d.data.upcoming.upcomingTable.rows",
             "filed": "d.data.filed.rows"}
    sections = F.array(*[F.struct(F.lit(rank).alias("section_rank"), F.col(paths[section]).alias("rows"))
                         for rank, (section, _) in enumerate(NASDAQ_SECTIONS)])
    pages = parsed(docs.where(F.col("month").between(lo, hi)), NASDAQ_SCHEMA, "month", "page")
    rows = (pages.select("month", "page", F.explode(sections).alias("s"))
            .select("month", "page", "s.section_rank", F.posexplode("s.rows").alias("pos", "r")))
    date = None
    for rank, (_, date_key) in enumerate(NASDAQ_SECTIONS):
        date = (F.when if date is None else date.when)(F.col("section_rank") == rank, F.col(f"r.{date_key}"))
    return rows.select("month", "page", "section_rank", "pos", "r.*", date.alias("raw_date_text"))


def unreadable_nasdaq(docs: DataFrame) -> DataFrame:
    """The calendar pages that cannot be read, as they landed."""
    return quarantine(docs, NASDAQ_SCHEMA, "nasdaq", "month", "page")


def unreadable_nyse(docs: DataFrame) -> DataFrame:
    return quarantine(docs, NYSE_SCHEMA, "nyse", "page")


def _place(c: str) -> Column:
    """A count as text that sorts like the number, for any 64-bit value."""
    return F.lpad(F.col(c).cast("string"), 19, "0")


def nasdaq_candidates(docs: DataFrame, as_of: Column, lookback: int = 1, lookahead: int = 2) -> DataFrame:
    """One candidate per deal id (a missing id is one key), the first in
    (month, section, page, position) order, as a month's sections are read one
    after the other; withdrawn deals are not read."""
    rows = nasdaq_rows(docs, as_of, lookback, lookahead)
    first = first_per_key(rows.withColumn("_deal", F.coalesce("dealID", F.lit(""))), ["_deal"],
                          [F.col("month"), F.col("section_rank"), F.col("page"), F.col("pos")])
    ord_ = F.concat_ws("/", "month", F.col("section_rank").cast("string"), _place("page"), _place("pos"))
    return first.select(
        F.lit(0).alias("source_rank"), ord_.alias("ord"),
        py_strip(F.coalesce("companyName", F.lit(""))).alias("company_name"),
        blank_to_null("proposedTickerSymbol").alias("ticker"),
        blank_to_null("proposedExchange").alias("exchange"),
        F.lit(NASDAQ_SOURCE_URL).alias("source_url"),
        F.when(F.col("raw_date_text") != "", F.col("raw_date_text")).alias("raw_date_text"))


def nyse_candidates(docs: DataFrame) -> DataFrame:
    """Every non-withdrawn row; date = pricing date, else first filing
    date (epoch ms, placeholders read as missing)."""
    rows = parsed(docs, NYSE_SCHEMA, "page").select("page", F.posexplode("d.calendarList").alias("pos", "r"))
    kept = rows.where(~F.col("r.deal_status_flg").eqNullSafe("W"))
    date = F.coalesce(epoch_ms_to_date(F.col("r.price_dt")), epoch_ms_to_date(F.col("r.init_file_dt")))
    return kept.select(
        F.lit(1).alias("source_rank"), F.concat_ws("/", _place("page"), _place("pos")).alias("ord"),
        py_strip(F.coalesce("r.issuer_nm", F.lit(""))).alias("company_name"),
        blank_to_null("r.symbol").alias("ticker"),
        blank_to_null("r.custom_group_exchange_nm").alias("exchange"),
        F.lit(NYSE_SOURCE_URL).alias("source_url"),
        date.cast("string").alias("raw_date_text"))
