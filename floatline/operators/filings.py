"""Filing operators: best filing, sync, status, worklists, outcomes.

D5 idempotent insert, D8 status state machine, D10 best filing, D11 parse
worklist, D13 mark parsed, D14 lock-up dates, D15 outcome counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.operators.ranking import assign_ids, first_per_key, max_id

# FIXED VALUES: forms followed, and the best-filing ladder (lower is better).
TARGET_FORMS = ["S-1", "S-1/A", "F-1", "F-1/A", "424B4", "424B1", "RW"]
FILING_FORMS = ["S-1", "S-1/A", "F-1", "F-1/A", "424B4", "424B1"]
FORM_TIERS = [["424B4"], ["424B1"], ["S-1/A", "F-1/A"], ["S-1", "F-1"]]
# FIXED VALUES: statuses.
STATUSES = ["candidate", "filed", "priced", "trading", "withdrawn"]
NO_DOWNGRADE = ["priced", "trading"]

FILING_COLS = ["id", "issuer_id", "accession_no", "form_type", "filing_date",
               "primary_doc_url", "filing_index_url", "is_parsed"]


def form_tier(form: Column) -> Column:
    out = None
    for rank, forms in enumerate(FORM_TIERS, start=1):
        out = (F.when if out is None else out.when)(form.isin(*forms), F.lit(rank))
    return out


def best_filing(filings: DataFrame) -> DataFrame:
    """Per issuer, best tier, then latest date (missing date last), then
    the earliest stored row.  Issuers with no ladder form get no row."""
    ranked = filings.withColumn("_tier", form_tier(F.col("form_type"))).where(F.col("_tier").isNotNull())
    return first_per_key(ranked, ["issuer_id"],
                         [F.col("_tier"), F.col("filing_date").desc_nulls_last(), F.col("id")]).drop("_tier")


# ── Sync (S3 rows -> filings) ─────────────────────────────────────────────────


def _sync_order():
    # Processing order of the tracked job: issuer, date descending ('' last),
    # then position in the landed documents.
    return [F.col("issuer_id"), F.coalesce("filing_date", F.lit("")).desc(), F.col("page"), F.col("pos")]


def new_filings(found: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D5 (selection): found filings not yet stored under (issuer_id,
    accession_no, form_type).  Rows without accession or form are ignored; a
    key repeated inside the landed documents is kept once and the rest count
    as skipped.

    ``found``: issuer_id, accession_no, form_type, filing_date (string),
    primary_doc_url, filing_index_url, page, pos.
    Returns (new rows without ids, per-issuer counts inserted/skipped).
    """
    valid = found.where((F.coalesce("accession_no", F.lit("")) != "")
                        & (F.coalesce("form_type", F.lit("")) != ""))
    key = ["issuer_id", "accession_no", "form_type"]
    first = first_per_key(valid, key, _sync_order()[1:])
    new = first.join(filings.select(*key), key, "left_anti")
    counts = (valid.groupBy("issuer_id").agg(F.count(F.lit(1)).alias("_valid"))
              .join(new.groupBy("issuer_id").agg(F.count(F.lit(1)).alias("inserted")),
                    "issuer_id", "left")
              .select("issuer_id", F.coalesce("inserted", F.lit(0)).alias("inserted"),
                      (F.col("_valid") - F.coalesce("inserted", F.lit(0))).alias("skipped")))
    return new, counts


def number_filings(new: DataFrame, start: int) -> DataFrame:
    """D5 (insert): new rows numbered after ``start``, the highest id so far, in job order."""
    return assign_ids(new, _sync_order(), start).select(
        "id", "issuer_id", "accession_no", "form_type",
        F.col("filing_date").try_cast("date").alias("filing_date"),
        "primary_doc_url", "filing_index_url", F.lit(False).alias("is_parsed"))


def sync_filings(found: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new filing rows with ids, per-issuer counts)."""
    new, counts = new_filings(found, filings)
    return number_filings(new, max_id(filings)), counts


def derive_status(found: DataFrame, issuers: DataFrame) -> DataFrame:
    """New status from the forms in each issuer's landed documents.

    RW -> withdrawn always; priced/trading stay; any filing form moves every
    other status but withdrawn to filed; otherwise unchanged.  A null or
    empty status counts as candidate.  Issuers whose documents list no
    target form are not touched.
    Returns issuer_id, old_status, new_status, changed.
    """
    valid = (F.coalesce("accession_no", F.lit("")) != "") & (F.coalesce("form_type", F.lit("")) != "")
    forms = found.groupBy("issuer_id").agg(
        F.bool_or(valid & (F.col("form_type") == "RW")).alias("_rw"),
        F.bool_or(valid & F.col("form_type").isin(*FILING_FORMS)).alias("_filing"))
    cur = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("candidate"))
    j = issuers.select(F.col("id").alias("issuer_id"), "status").join(forms, "issuer_id")
    new = (F.when(F.col("_rw"), F.lit("withdrawn"))
           .when(cur.isin(*NO_DOWNGRADE), cur)
           .when(F.col("_filing") & (cur != "withdrawn"), F.lit("filed"))
           .otherwise(cur))
    return j.select("issuer_id", F.col("status").alias("old_status"), new.alias("new_status"),
                    (~F.col("status").eqNullSafe(new)).alias("changed"))


def apply_status(issuers: DataFrame, transitions: DataFrame) -> DataFrame:
    t = transitions.where("changed").select("issuer_id", "new_status")
    j = issuers.join(t, issuers.id == t.issuer_id, "left")
    return j.select(*[F.coalesce("new_status", issuers.status).alias("status") if c == "status"
                      else issuers[c] for c in issuers.columns])


# ── Parse worklist and outcomes ───────────────────────────────────────────────

def parse_worklist(issuers: DataFrame, filings: DataFrame, documents: DataFrame,
                   force: bool = False, skip_existing: DataFrame | None = None) -> DataFrame:
    """D11 (+D15): one row per issuer with its best filing and an outcome.

    outcome: ``parse`` (document landed and non-empty), ``skipped`` (no best
    filing, no URL, already parsed, existing row, empty document) or
    ``failed`` (document not landed).  ``skip_existing`` (issuer_id,
    filing_id) replaces the is_parsed gate, as the lock-up job does.
    Only a landed/empty flag per URL is joined here, never the HTML, so the
    worklist stays one small row per issuer.
    """
    best = best_filing(filings).select(
        F.col("issuer_id"), F.col("id").alias("filing_id"), "form_type", "filing_date",
        "primary_doc_url", "is_parsed")
    w = issuers.select(F.col("id").alias("issuer_id")).join(best, "issuer_id", "left")
    if skip_existing is not None:
        ex = skip_existing.select("issuer_id", "filing_id").distinct().withColumn("_exists", F.lit(True))
        w = w.join(ex, ["issuer_id", "filing_id"], "left")
        done = F.coalesce("_exists", F.lit(False))
    else:
        done = F.coalesce("is_parsed", F.lit(False))
    # Size recorded at landing (n_chars) when present: the worklist then reads
    # two small columns of the documents table, never the pages themselves.
    size = F.col("n_chars") if "n_chars" in documents.columns else F.length("html")
    docs = documents.select(F.col("url").alias("_url"),
                            F.coalesce(size, F.lit(0)).cast("long").alias("doc_chars"))
    # Issuers without a URL cannot match; kept out of the join they do not meet on one key.
    w = (w.where(F.col("primary_doc_url").isNotNull()).join(docs, F.col("primary_doc_url") == F.col("_url"), "left")
         .unionByName(w.where(F.col("primary_doc_url").isNull()), allowMissingColumns=True))
    reason = (F.when(F.col("filing_id").isNull(), F.lit("no_best_filing"))
              .when(F.coalesce("primary_doc_url", F.lit("")) == "", F.lit("no_url"))
              .when(done & F.lit(not force), F.lit("already_parsed"))
              .when(F.col("_url").isNull(), F.lit("document_missing"))
              .when(F.col("doc_chars") == 0, F.lit("empty_document")))
    outcome = (F.when(reason.isNull(), F.lit("parse"))
               .when(reason == "document_missing", F.lit("failed"))
               .otherwise(F.lit("skipped")))
    return w.select("issuer_id", "filing_id", "form_type", "filing_date", "primary_doc_url",
                    "doc_chars", outcome.alias("outcome"), reason.alias("reason"))


def run_stats(worklist: DataFrame) -> DataFrame:
    """issuer_count, parsed, skipped, failed of one job run."""
    return worklist.agg(
        F.count(F.lit(1)).alias("issuer_count"),
        F.count_if(F.col("outcome") == "parse").alias("parsed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))


def mark_parsed(filings: DataFrame, parsed: DataFrame) -> DataFrame:
    """Filings of parsed issuers get is_parsed = true."""
    p = parsed.select(F.col("filing_id").alias("_pid")).distinct()
    j = filings.join(p, filings.id == p._pid, "left")
    return j.select(*[(F.col("is_parsed") | F.col("_pid").isNotNull()).alias("is_parsed")
                      if c == "is_parsed" else filings[c] for c in filings.columns])


def lockup_dates(start: Column, days: Column) -> tuple[Column, Column]:
    """start = best filing's date; end = start + days."""
    return start, F.when(start.isNotNull() & days.isNotNull(), F.date_add(start, days))
