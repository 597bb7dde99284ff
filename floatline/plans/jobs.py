"""The five jobs of a daily run (J1-J5), as functions over DataFrames.

Each job takes the current table snapshots and landed inputs and returns the
new snapshots plus a small stats frame; nothing is collected row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions.text import html_to_text
from floatline.operators import candidates as C
from floatline.operators import filings as FL
from floatline.operators import upserts as U
from floatline.operators.ranking import max_id
from floatline.plans import reports as R
from floatline.session import materialize
from floatline.sources import sec


class LazyTables(Mapping):
    """Output tables built on first access, by whatever way they are read: a
    caller reading one table does not pay for the others."""

    def __init__(self, builders: dict[str, DataFrame | Callable[[], DataFrame]]):
        self._builders = dict(builders)

    def __getitem__(self, key: str) -> DataFrame:
        value = self._builders[key]
        if not isinstance(value, DataFrame):
            value = self._builders[key] = value()
        return value

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass
class JobResult:
    tables: Mapping
    stats: DataFrame


# ── J1 ────────────────────────────────────────────────────────────────────────

def discover_candidates(issuers: DataFrame, *sources: DataFrame | None,
                        as_of: Column | str | None = None, patterns: bool = False) -> JobResult:
    """Union sources -> dedup -> match (once, written) -> fill/insert issuers.
    ``patterns``: ``%`` and ``_`` in candidate names are wildcards (D3)."""
    unique = C.dedup_candidates(C.union_sources(*sources))
    matched = materialize(C.match_issuers(unique, issuers, patterns))
    new_issuers, actions = C.upsert_issuers(matched, issuers, as_of=R.as_of_col(as_of))
    return JobResult(LazyTables({"issuers": new_issuers, "actions": actions}), C.candidate_stats(actions))


# ── J2 ────────────────────────────────────────────────────────────────────────

def sync_sec_filings(issuers: DataFrame, filings: DataFrame, submissions: DataFrame) -> JobResult:
    """Landed submissions -> new filings (idempotent) + status changes.

    The documents are parsed once into the found filings, which are written.
    Issuers with a CIK but no landed document, one that cannot be read, or a
    CIK that is not an integer, count as failed; ``failures`` lists them with
    the reason, ``quarantine`` the unreadable documents.  A failure is the
    document's own: an issuer's readable documents are used."""
    with_cik = issuers.where(F.col("cik").isNotNull())
    found, failed = sec.issuer_filings(with_cik, submissions)
    new, counts = FL.new_filings(found, filings)

    @cache
    def numbered() -> DataFrame:
        return FL.number_filings(new, max_id(filings))

    def stats() -> DataFrame:
        return (with_cik.agg(F.count(F.lit(1)).alias("issuer_count"))
                .join(counts.agg(F.coalesce(F.sum("inserted"), F.lit(0)).cast("long").alias("filings_inserted"),
                                 F.coalesce(F.sum("skipped"), F.lit(0)).cast("long").alias("filings_skipped")), how="left")
                .join(failed.agg(F.count(F.lit(1)).alias("filings_failed")), how="left"))

    transitions = FL.derive_status(found, with_cik)
    return JobResult(LazyTables({"filings": lambda: filings.unionByName(numbered(), allowMissingColumns=True),
                                 "new_filings": numbered,
                                 "issuers": lambda: FL.apply_status(issuers, transitions),
                                 "transitions": transitions, "failures": failed,
                                 "quarantine": lambda: sec.unreadable_submissions(submissions)}), stats())


# ── J3 / J4 shared text ───────────────────────────────────────────────────────

def parse_texts(worklist: DataFrame, documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """F7 over the documents to parse: issuer_id, filing_id, form_type,
    filing_date, text (and the ``carry`` columns of the worklist).  A day's
    worklist is small beside the pages; Spark broadcasts it by its own size
    estimate, so pages are converted where they are read."""
    todo = worklist.where(F.col("outcome") == "parse").select(
        "issuer_id", "filing_id", "form_type", "filing_date", "primary_doc_url", *carry)
    docs = documents.select(F.col("url").alias("_url"), "html")
    joined = docs.join(todo, F.col("_url") == F.col("primary_doc_url"), "inner")
    return joined.select("issuer_id", "filing_id", "form_type", "filing_date", *carry, html_to_text("html").alias("text"))


# Raw fields (X1-X9) that each table needs; D12 needs the share counts.
_SHARES = ["shares_offered_direct", "shares_primary", "shares_secondary"]
OFFERING_FIELDS = ["offer_price", "price_range_low", "price_range_high", *_SHARES, "greenshoe_shares", "bookrunners"]
CAP_FIELDS = [*_SHARES, "shares_outstanding_post_ipo", "shares_outstanding_pre_ipo", "fully_diluted_shares"]


def offering_fields(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """X1-X9 (or only ``fields``) then D12 over a text table; a measure whose
    inputs were not extracted is left out."""
    raw = X.with_offering_fields(texts.select("issuer_id", "filing_id", "form_type", "text"), fields=fields).drop("text")
    none = F.lit(None).cast("double")
    have = lambda c: F.col(c) if c in raw.columns else none
    total, gross, ratio = U.derived_measures(have("offer_price"), F.col("shares_offered_direct"), F.col("shares_primary"),
                                             F.col("shares_secondary"), have("shares_outstanding_post_ipo"))
    out = raw.withColumn("shares_offered_total", total)
    if "offer_price" in raw.columns:
        out = out.withColumn("gross_proceeds", gross)
    if "shares_outstanding_post_ipo" in raw.columns:
        out = out.withColumn("float_ratio", ratio)
    return out.drop("shares_offered_direct")


def fresh_offerings(fields: DataFrame, issuers: DataFrame) -> DataFrame:
    ex = issuers.select(F.col("id").alias("_iid"), F.col("exchange"))
    return (fields.join(ex, fields.issuer_id == ex._iid, "left")
            .select("issuer_id", "filing_id", F.col("form_type").alias("source_form_type"),
                    *[c for c in U.OFFERING_SET if c != "source_form_type"]))


def fresh_capitalization(fields: DataFrame) -> DataFrame:
    return fields.select("issuer_id", "filing_id", "shares_outstanding_post_ipo",
                         "shares_outstanding_pre_ipo", "fully_diluted_shares",
                         F.col("shares_offered_total").alias("free_float_at_ipo"), "float_ratio")


def lockup_fields(texts: DataFrame) -> DataFrame:
    """X10-X13 and D14 over a text table."""
    f = X.with_lockup_fields(texts.select("issuer_id", "filing_id", "filing_date", "text"))
    start, end = FL.lockup_dates(F.col("filing_date"), F.col("lockup_days"))
    return f.select(
        "issuer_id", "filing_id", "lockup_days", start.alias("lockup_start_date"),
        end.alias("lockup_end_date"), "is_staged_unlock", "unlock_notes", "confidence")


# ── J3 ────────────────────────────────────────────────────────────────────────

def parse_offering_data(issuers: DataFrame, filings: DataFrame, documents: DataFrame,
                        offerings: DataFrame, capitalization: DataFrame,
                        as_of: Column | str | None = None, force: bool = False) -> JobResult:
    """Best filing -> text -> offering and capitalization fields ->
    upserts; best filings parsed are marked."""
    d = R.as_of_col(as_of)
    work = materialize(FL.parse_worklist(issuers, filings, documents, force=force))

    @cache
    def fields(which: str) -> DataFrame:
        wanted = {"offerings": OFFERING_FIELDS, "capitalization": CAP_FIELDS, "all": None}[which]
        return materialize(offering_fields(parse_texts(work, documents), wanted))

    return JobResult(LazyTables({
        "offerings": lambda: U.upsert_offerings(offerings, fresh_offerings(fields("offerings"), issuers), d),
        "capitalization": lambda: U.upsert_capitalization(capitalization, fresh_capitalization(fields("capitalization")), d),
        "filings": lambda: FL.mark_parsed(filings, work.where(F.col("outcome") == "parse")),
        "fields": lambda: fields("all"),
        "worklist": work,
    }), FL.run_stats(work))


# ── J4 ────────────────────────────────────────────────────────────────────────

def parse_lockups(issuers: DataFrame, filings: DataFrame, documents: DataFrame,
                  lockups: DataFrame, as_of: Column | str | None = None,
                  force: bool = False) -> JobResult:
    """Best filing -> text -> lock-up fields -> upsert.  Gated on an
    existing lock-up row for the best filing (not on is_parsed)."""
    d = R.as_of_col(as_of)
    work = materialize(FL.parse_worklist(issuers, filings, documents, force=force,
                                         skip_existing=lockups))

    @cache
    def fresh() -> DataFrame:
        return materialize(lockup_fields(parse_texts(work, documents)))

    return JobResult(LazyTables({"lockups": lambda: U.upsert_lockups(lockups, fresh(), d, force=force),
                                 "fields": fresh, "worklist": work}), FL.run_stats(work))


# ── J5 ────────────────────────────────────────────────────────────────────────

def export_reports(tables: Mapping, as_of=None) -> dict[str, DataFrame]:
    """The three report frames, keyed by their file names."""
    t = tables
    return {
        "upcoming_ipos.csv": R.upcoming_ipos(t["issuers"], t["filings"], t["offerings"], as_of),
        "recent_ipos.csv": R.recent_ipos(t["issuers"], t["offerings"], t["capitalization"],
                                         t["lockups"], as_of),
        "upcoming_unlocks.csv": R.upcoming_unlocks(t["issuers"], t["offerings"], t["filings"],
                                                   t["lockups"], as_of),
    }
