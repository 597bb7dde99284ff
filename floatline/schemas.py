"""Declared schemas of the stored tables.

Share counts and prices are doubles, dates are dates, keys are longs.
``conform`` gives a landed or older frame the declared columns (missing ones
null, types cast) and keeps every other column behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_ID, _TEXT, _DAY, _NUM, _FLAG = T.LongType(), T.StringType(), T.DateType(), T.DoubleType(), T.BooleanType()

ISSUERS = _table(id=_ID, company_name=_TEXT, cik=_TEXT, ticker=_TEXT, exchange=_TEXT, country=_TEXT,
                 is_foreign_issuer=_FLAG, status=_TEXT, source_url=_TEXT, created_at=_DAY, updated_at=_DAY)
FILINGS = _table(id=_ID, issuer_id=_ID, accession_no=_TEXT, form_type=_TEXT, filing_date=_DAY,
                 primary_doc_url=_TEXT, filing_index_url=_TEXT, is_parsed=_FLAG, created_at=_DAY)
OFFERINGS = _table(id=_ID, issuer_id=_ID, filing_id=_ID, source_form_type=_TEXT, price_range_low=_NUM,
                   price_range_high=_NUM, offer_price=_NUM, pricing_date=_DAY, expected_trade_date=_DAY,
                   shares_offered_total=_NUM, shares_primary=_NUM, shares_secondary=_NUM, greenshoe_shares=_NUM,
                   gross_proceeds=_NUM, exchange=_TEXT, bookrunners=_TEXT, parsed_at=_DAY)
CAPITALIZATION = _table(id=_ID, issuer_id=_ID, filing_id=_ID, shares_outstanding_pre_ipo=_NUM,
                        shares_outstanding_post_ipo=_NUM, free_float_at_ipo=_NUM, float_ratio=_NUM,
                        fully_diluted_shares=_NUM, parsed_at=_DAY)
LOCKUPS = _table(id=_ID, issuer_id=_ID, filing_id=_ID, lockup_days=T.IntegerType(), lockup_start_date=_DAY,
                 lockup_end_date=_DAY, is_staged_unlock=_FLAG, unlock_notes=_TEXT, unlock_shares_estimate=_NUM,
                 confidence=_TEXT, parsed_at=_DAY)
RAW_DOCUMENTS = _table(url=_TEXT, html=_TEXT, n_chars=_ID, fetched_at=T.TimestampType())

TABLES = {"issuers": ISSUERS, "filings": FILINGS, "offerings": OFFERINGS,
          "capitalization": CAPITALIZATION, "lockups": LOCKUPS}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    declared = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*declared, *[c for c in df.columns if c not in schema.names])
