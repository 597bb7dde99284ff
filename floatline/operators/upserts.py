"""Keyed upserts into the parsed tables, and derived measures.

Plain parquet has no MERGE, so an upsert is one full outer join of the stored
table with the new rows on the logical key, written as a new table.  New rows are numbered after the
current max id in issuer order, as the tracked job inserts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.functions.scalars import keep_new
from floatline.operators.ranking import assign_ids, max_id
from floatline.session import materialize

OFFERING_COLS = ["id", "issuer_id", "filing_id", "source_form_type", "offer_price",
                 "pricing_date", "expected_trade_date", "price_range_low", "price_range_high",
                 "shares_offered_total", "shares_primary", "shares_secondary",
                 "greenshoe_shares", "gross_proceeds", "bookrunners", "exchange", "parsed_at"]
OFFERING_SET = ["source_form_type", "offer_price", "price_range_low", "price_range_high",
                "shares_offered_total", "shares_primary", "shares_secondary",
                "greenshoe_shares", "gross_proceeds", "bookrunners", "exchange"]
CAP_COLS = ["id", "issuer_id", "filing_id", "shares_outstanding_pre_ipo",
            "shares_outstanding_post_ipo", "free_float_at_ipo", "float_ratio",
            "fully_diluted_shares", "parsed_at"]
CAP_SET = ["shares_outstanding_post_ipo", "shares_outstanding_pre_ipo",
           "fully_diluted_shares", "free_float_at_ipo", "float_ratio"]
LOCKUP_COLS = ["id", "issuer_id", "filing_id", "lockup_days", "lockup_start_date",
               "lockup_end_date", "is_staged_unlock", "unlock_notes",
               "unlock_shares_estimate", "confidence", "parsed_at"]
LOCKUP_SET = ["lockup_days", "lockup_start_date", "lockup_end_date", "is_staged_unlock",
              "unlock_notes", "confidence"]
KEY = ["issuer_id", "filing_id"]


def derived_measures(price: Column, total: Column, primary: Column, secondary: Column,
                     post: Column) -> tuple[Column, Column, Column]:
    """(shares_total, gross_proceeds, float_ratio).

    Total is primary + secondary when both exist, else the direct figure,
    else primary, else secondary.  Zero counts as missing for proceeds and
    ratio, and the ratio needs a positive post-offering count.
    """
    shares_total = (F.when(primary.isNotNull() & secondary.isNotNull(), primary + secondary)
                    .when(total.isNotNull(), total)
                    .otherwise(F.coalesce(primary, secondary)))
    truthy = lambda c: c.isNotNull() & (c != 0)
    gross = F.when(truthy(price) & truthy(shares_total), price * shares_total)
    ratio = F.when(truthy(shares_total) & post.isNotNull() & (post > 0), shares_total / post)
    return shares_total, gross, ratio


def _upsert(stored: DataFrame, fresh: DataFrame, cols: list[str], set_cols: list[str],
            as_of: Column, keep_nulls: bool, insert_only: bool = False) -> DataFrame:
    """Stored rows matched on KEY take the fresh values (null keeps the old
    value unless ``keep_nulls``) and parsed_at = as_of, or stay as they are with
    ``insert_only``; unmatched fresh rows are inserted with new ids.

    One full outer join on KEY, written once: the stored table is scanned once,
    and not shuffled where it is bucketed by KEY.  The new rows are then
    numbered after the highest id of what was written."""
    f = fresh.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in set_cols]).withColumn("_hit", F.lit(True))
    j = stored.withColumn("_old", F.lit(True)).join(f, KEY, "full_outer")
    new = F.col("_old").isNull()
    set_ = new if insert_only else F.coalesce(F.col("_hit"), F.lit(False))

    def merged(c: str) -> Column:
        kind = stored.schema[c].dataType
        if c == "parsed_at":
            return F.when(set_, as_of.cast(kind)).otherwise(F.col(c))
        if c not in set_cols:
            return F.col(c)
        value = F.col(f"_new_{c}").cast(kind)
        return F.when(set_, value if keep_nulls else keep_new(value, F.col(c))).otherwise(F.col(c))

    out = materialize(j.select(*[merged(c).alias(c) for c in cols], new.alias("_inserted")))
    inserted = out.where("_inserted").drop("id", "_inserted")
    numbered = assign_ids(inserted, [F.col("issuer_id"), F.col("filing_id")], max_id(out))
    kind = stored.schema["id"].dataType
    return out.where("NOT _inserted").select(*cols).unionByName(numbered.withColumn("id", F.col("id").cast(kind)).select(*cols))


def upsert_offerings(stored: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """D6 (offerings): null-preserving update on (issuer_id, filing_id)."""
    return _upsert(stored, fresh, OFFERING_COLS, OFFERING_SET, as_of, keep_nulls=False)


def upsert_capitalization(stored: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """D6 (capitalization)."""
    return _upsert(stored, fresh, CAP_COLS, CAP_SET, as_of, keep_nulls=False)


def upsert_lockups(stored: DataFrame, fresh: DataFrame, as_of: Column, force: bool = False) -> DataFrame:
    """Without force only new keys are inserted; with force stored rows are
    overwritten including nulls, unlock_shares_estimate kept."""
    return _upsert(stored, fresh, LOCKUP_COLS, LOCKUP_SET, as_of, keep_nulls=True, insert_only=not force)


def store_bucketed(table: DataFrame, name: str, buckets: int) -> DataFrame:
    """``table`` as the catalog table ``name``, hashed on KEY into ``buckets``
    sorted files: upserts into it shuffle their few fresh rows only."""
    (table.repartition(buckets, *KEY).write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY)
     .format("parquet").saveAsTable(name))
    return table.sparkSession.table(name)
