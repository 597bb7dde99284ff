"""Date-window reports (R1-R3) and latest-row-per-issuer.

Each report is one plan: the latest rows per issuer are computed once per
table (top-1 per key, partial before the shuffle) and equi-joined, instead
of one lookup per output row.  "Latest" is highest parsed_at, then lowest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.operators.ranking import first_per_key

# FIXED VALUES: report windows in days.
UPCOMING_IPO_FILING_LOOKBACK_DAYS = 60
RECENT_IPO_PRICING_LOOKBACK_DAYS = 30
UPCOMING_UNLOCK_LOOKAHEAD_DAYS = 30
UPCOMING_STATUSES = ["candidate", "filed", "priced"]

UPCOMING_IPOS_COLS = ["company_name", "cik", "ticker", "exchange", "filing_status",
                      "price_range_low", "price_range_high", "offer_price", "pricing_date",
                      "expected_trade_date", "shares_offered_total", "shares_primary",
                      "shares_secondary", "greenshoe_shares", "bookrunners",
                      "latest_prospectus_url"]
RECENT_IPOS_COLS = ["company_name", "ticker", "exchange", "offer_price", "pricing_date",
                    "trade_date", "shares_offered_total", "shares_outstanding_post_ipo",
                    "free_float_at_ipo", "float_ratio", "lockup_days", "lockup_end_date"]
UPCOMING_UNLOCKS_COLS = ["company_name", "ticker", "offer_price", "trade_date", "lockup_days",
                         "lockup_end_date", "is_staged_unlock", "unlock_notes",
                         "unlock_shares_estimate", "source_filing_url"]


def as_of_col(as_of: str | Column | None) -> Column:
    """Report date: a literal (repeatable runs) or today."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def latest_per_issuer(df: DataFrame) -> DataFrame:
    """The row with the highest parsed_at (then lowest id) per issuer."""
    return first_per_key(df, ["issuer_id"], [F.col("parsed_at").desc_nulls_last(), F.col("id")])


def upcoming_ipos(issuers: DataFrame, filings: DataFrame, offerings: DataFrame,
                  as_of=None, sort: bool = True) -> DataFrame:
    """Active issuers with a filing in the last 60 days (any form, no upper
    bound), their latest such filing's URL and latest offering figures."""
    d = as_of_col(as_of)
    recent = filings.where(F.col("filing_date") >= F.date_sub(d, UPCOMING_IPO_FILING_LOOKBACK_DAYS))
    latest_filing = first_per_key(recent, ["issuer_id"], [F.col("filing_date").desc(), F.col("id")])
    off = latest_per_issuer(offerings).drop("id", "filing_id", "exchange", "parsed_at")
    i = issuers.where(F.col("status").isin(*UPCOMING_STATUSES))
    j = (i.join(latest_filing.select("issuer_id", F.col("primary_doc_url").alias("latest_prospectus_url")),
                i.id == F.col("issuer_id"), "inner").drop("issuer_id")
         .join(off, i.id == off.issuer_id, "left"))
    out = j.select(i.company_name, i.cik, i.ticker, i.exchange, i.status.alias("filing_status"),
                   *[F.col(c) for c in UPCOMING_IPOS_COLS[5:]])
    return out.orderBy("company_name") if sort else out


def recent_ipos(issuers: DataFrame, offerings: DataFrame, capitalization: DataFrame,
                lockups: DataFrame, as_of=None, sort: bool = True) -> DataFrame:
    """R2: one row per offering priced in the last 30 days (with a price),
    with the issuer's latest capitalization and lock-up."""
    d = as_of_col(as_of)
    o = offerings.where(F.col("offer_price").isNotNull()
                        & (F.col("pricing_date") >= F.date_sub(d, RECENT_IPO_PRICING_LOOKBACK_DAYS)))
    cap = latest_per_issuer(capitalization).select(
        F.col("issuer_id").alias("_cap_issuer"), "shares_outstanding_post_ipo",
        "free_float_at_ipo", "float_ratio")
    lk = latest_per_issuer(lockups).select(
        F.col("issuer_id").alias("_lk_issuer"), "lockup_days", "lockup_end_date")
    i = issuers.select(F.col("id").alias("_iid"), "company_name", "ticker", "exchange")
    j = (o.select("issuer_id", "offer_price", "pricing_date",
                  F.col("expected_trade_date").alias("trade_date"), "shares_offered_total")
         .join(i, F.col("issuer_id") == F.col("_iid"), "inner")
         .join(cap, F.col("issuer_id") == F.col("_cap_issuer"), "left")
         .join(lk, F.col("issuer_id") == F.col("_lk_issuer"), "left"))
    out = j.select(*RECENT_IPOS_COLS)
    return out.orderBy(F.col("pricing_date").desc()) if sort else out


def upcoming_unlocks(issuers: DataFrame, offerings: DataFrame, filings: DataFrame,
                     lockups: DataFrame, as_of=None, sort: bool = True) -> DataFrame:
    """Lock-ups ending within [as_of, as_of + 30] (any issuer status),
    with the issuer's latest offering and the lock-up's source filing URL."""
    d = as_of_col(as_of)
    lk = lockups.where(F.col("lockup_end_date").between(
        d, F.date_add(d, UPCOMING_UNLOCK_LOOKAHEAD_DAYS)))
    off = latest_per_issuer(offerings).select(
        F.col("issuer_id").alias("_off_issuer"), "offer_price",
        F.col("expected_trade_date").alias("trade_date"))
    i = issuers.select(F.col("id").alias("_iid"), "company_name", "ticker")
    f = filings.select(F.col("id").alias("_fid"), F.col("primary_doc_url").alias("source_filing_url"))
    j = (lk.join(i, F.col("issuer_id") == F.col("_iid"), "inner")
         .join(off, F.col("issuer_id") == F.col("_off_issuer"), "left")
         .join(f, F.col("filing_id") == F.col("_fid"), "left"))
    out = j.select(*UPCOMING_UNLOCKS_COLS)
    return out.orderBy("lockup_end_date") if sort else out
