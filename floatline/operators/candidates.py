"""Candidate issuers: union of sources, dedup, entity match, upsert.

Candidates carry their input order as ``(source_rank, ord)``; "first" always
means smallest in that order.  The issuer table is matched as it was before
the batch (a snapshot), so two new candidates that share only a ticker are
both inserted; fills inside the batch go to the first candidate offering a
value, and a later candidate that adds nothing counts as skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.functions.scalars import blank_to_null, py_strip
from floatline.operators.name_patterns import has_wildcard, least_match
from floatline.operators.ranking import assign_ids, first_per_key, max_id

CANDIDATE_COLS = ["source_rank", "ord", "company_name", "ticker", "exchange", "source_url"]
ISSUER_COLS = ["id", "company_name", "cik", "ticker", "exchange", "status", "source_url"]
FILL_FIELDS = ["exchange", "ticker", "source_url"]


def union_sources(*sources: DataFrame | None) -> DataFrame:
    """Sources in order; a missing (failed) source is skipped."""
    present = [s.select(*CANDIDATE_COLS) for s in sources if s is not None]
    if not present:
        raise ValueError("no candidate source available")
    return reduce(lambda a, b: a.unionByName(b), present)


def dedup_candidates(cands: DataFrame) -> DataFrame:
    """Key (upper(strip(ticker)) or '', lower(strip(name))); blank names
    dropped; the first candidate per key is kept."""
    keyed = (cands
             .withColumn("_tk", F.upper(py_strip(F.coalesce("ticker", F.lit("")))))
             .withColumn("_nk", F.lower(py_strip(F.coalesce("company_name", F.lit("")))))
             .where(F.col("_nk") != ""))
    return first_per_key(keyed, ["_tk", "_nk"], [F.col("source_rank"), F.col("ord")]).drop("_tk", "_nk")


def _prepared(cands: DataFrame) -> DataFrame:
    """Candidate values as written: stripped name and ticker, blank -> null."""
    return cands.select(
        "source_rank", "ord",
        py_strip(F.coalesce("company_name", F.lit(""))).alias("company_name"),
        blank_to_null("ticker").alias("ticker"),
        F.when(F.col("exchange") != "", F.col("exchange")).alias("exchange"),
        F.when(F.col("source_url") != "", F.col("source_url")).alias("source_url"))


def match_issuers(cands: DataFrame, issuers: DataFrame, patterns: bool = False) -> DataFrame:
    """D3: issuer by exact ticker when the candidate has one, else (or when
    that finds nothing) by case-insensitive name; lowest id wins.  With
    ``patterns``, ``%`` and ``_`` in a candidate's name are wildcards, as the
    tracked job reads them; names without any are matched by equality as before."""
    c = _prepared(cands)
    by_ticker = (issuers.where(F.col("ticker").isNotNull())
                 .groupBy(F.col("ticker").alias("_t")).agg(F.min("id").alias("_tid")))
    by_name = (issuers.groupBy(F.lower("company_name").alias("_n")).agg(F.min("id").alias("_nid")))
    # Candidates without a ticker cannot match by it; kept out of the join they do not meet on one key.
    # Issuers are shuffled: by their file's size Spark would take them for small enough to go through the driver.
    with_id = c.where(F.col("ticker").isNotNull()).join(by_ticker.hint("merge"), F.col("ticker") == F.col("_t"), "left").drop("_t")
    without = c.where(F.col("ticker").isNull()).withColumn("_tid", F.lit(None).cast("long"))
    m = with_id.unionByName(without)
    if patterns:
        asked = m.where(has_wildcard(F.col("company_name")) & F.col("_tid").isNull())
        found = least_match(asked.select(F.lower("company_name").alias("_p")),
                            by_name.select(F.col("_n").alias("_name"), F.col("_nid").alias("_id")))
        # A pattern that is also a name matches that name itself, so its row replaces the equal one.
        by_name = by_name.where(~has_wildcard(F.col("_n"))).unionByName(
            found.select(F.col("_p").alias("_n"), F.col("_id").alias("_nid")))
    m = m.join(by_name.hint("merge"), F.lower("company_name") == F.col("_n"), "left")
    return m.select(
        *c.columns,
        F.coalesce("_tid", "_nid").alias("issuer_id"),
        F.when(F.col("_tid").isNotNull(), F.lit("ticker"))
         .when(F.col("_nid").isNotNull(), F.lit("name")).alias("match_kind"))


def upsert_issuers(matched: DataFrame, issuers: DataFrame, status: str = "candidate", as_of: Column | None = None):
    """Fill blank exchange/ticker/source_url of matched issuers; insert
    the rest.  Returns (issuers', per-candidate actions).  Every column of the
    stored table stays; ``updated_at`` of filled rows and both time stamps of
    new ones are set to ``as_of`` where the table has them, and new issuers are not foreign until known."""
    as_of = F.current_date() if as_of is None else as_of
    hit = matched.where(F.col("issuer_id").isNotNull())
    order = F.struct("source_rank", "ord")
    # First candidate per issuer offering each field (partial aggregation:
    # a hot issuer costs one row per map task).
    firsts = hit.groupBy("issuer_id").agg(*[
        F.min_by(F.struct(order.alias("o"), F.col(f).alias("v")),
                 F.when(F.col(f).isNotNull(), order)).alias(f"_first_{f}")
        for f in FILL_FIELDS])
    old = issuers.select("id", *[F.col(f).alias(f"_old_{f}") for f in FILL_FIELDS])
    fills = firsts.join(old, firsts.issuer_id == old.id, "inner").drop("id")
    filled_by = fills.select("issuer_id", *[
        F.when((F.coalesce(F.col(f"_old_{f}"), F.lit("")) == "")
               & F.col(f"_first_{f}.v").isNotNull(), F.col(f"_first_{f}")).alias(f"_fill_{f}")
        for f in FILL_FIELDS])
    # Candidate actions: updated when it is the filler of at least one field.
    acts = hit.join(filled_by, "issuer_id", "left")
    is_filler = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(f"_fill_{f}.o") == order, F.lit(False)) for f in FILL_FIELDS])
    actions_hit = acts.select("source_rank", "ord", "issuer_id",
                              F.when(is_filler, F.lit("updated")).otherwise(F.lit("skipped")).alias("action"))
    # Issuer rows after the fill.
    upd = issuers.join(filled_by, issuers.id == filled_by.issuer_id, "left")
    filled = reduce(lambda a, b: a | b, [F.col(f"_fill_{f}").isNotNull() for f in FILL_FIELDS])

    def after_fill(f: str) -> Column:
        if f in FILL_FIELDS:
            return F.coalesce(F.col(f"_fill_{f}.v"), issuers[f]).alias(f)
        if f == "updated_at":
            return F.when(filled, as_of.cast(issuers.schema[f].dataType)).otherwise(issuers[f]).alias(f)
        return issuers[f]

    updated = upd.select(*[after_fill(f) for f in issuers.columns])
    # Inserts, numbered after the current max id in candidate order.
    new = matched.where(F.col("issuer_id").isNull())
    inserted = assign_ids(new, [F.col("source_rank"), F.col("ord")], max_id(issuers))
    known = {"status": F.lit(status), "created_at": as_of, "updated_at": as_of, "is_foreign_issuer": F.lit(False)}
    inserted_rows = inserted.select(*[
        (F.col(f.name) if f.name in ("id", "company_name", *FILL_FIELDS) else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in issuers.schema.fields])
    actions_new = inserted.select("source_rank", "ord", F.col("id").alias("issuer_id"),
                                  F.lit("inserted").alias("action"))
    return updated.unionByName(inserted_rows), actions_hit.unionByName(actions_new)


def candidate_stats(actions: DataFrame) -> DataFrame:
    """Counts of the discover job: total_fetched, inserted, updated, skipped."""
    return actions.agg(
        F.count(F.lit(1)).alias("total_fetched"),
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action") == "skipped").alias("skipped"))
