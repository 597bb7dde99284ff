"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables through the fixture views of
``floatline.sources.fixtures`` (so its work grows with them) and runs the
library operator over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions import scalars as S
from floatline.functions import text as TX
from floatline.operators import candidates as C
from floatline.operators import filings as FL
from floatline.operators.constraints import constraint_violations
from floatline.operators.partitioning import spread_small
from floatline.plans import jobs as J
from floatline.plans import reports as R
from floatline.session import apply_job_conf, materialize, parallelism
from floatline.sources import calendars as CAL
from floatline.sources import landing as L
from floatline.sources import sec
from floatline.sources.fixtures import AS_OF, Fixtures

# Filings dated before this are the stored state for the sync queries; the
# landed submissions list every filing, so later ones are new.
SYNC_STORED_BEFORE = "1998-08-01"
LANDED_DOCS_PER_FILE = 1000
# FIXED VALUES of the F8 query: section titles tried in order.
FIND_SECTION_TITLES = ["Summary", "Underwriting", "quelle", "und der", "the"]


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    apply_job_conf(spark)
    return Fixtures(spark, sf_dir)


def _as_of():
    return F.lit(AS_OF).cast("date")


# ── Scalars ───────────────────────────────────────────────────────────────────

def q_normalize_cik(spark, sf_dir):
    c = _fx(spark, sf_dir)["customer"]
    k = F.col("c_custkey")
    raw = (F.when(k % 7 == 0, F.concat(F.lit("abc"), k.cast("string")))
           .when(k % 7 == 1, F.concat(F.lit(" 00"), k.cast("string"), F.lit(" ")))
           .when(k % 7 == 2, (k * 100000000).cast("string"))
           .when(k % 7 == 3, F.concat(F.lit("-"), k.cast("string")))
           .otherwise((k + 320000).cast("string")))
    return c.select(k.alias("id"), raw.alias("raw")).select("id", "raw", S.normalize_cik("raw").alias("cik10"))


def q_parse_number(spark, sf_dir):
    o = _fx(spark, sf_dir)["orders"]
    k = F.col("o_orderkey")
    raw = (F.when(k % 6 == 0, F.format_number(k * 1013, 0))
           .when(k % 6 == 1, F.concat((k % 900).cast("string"), F.lit("."),
                                      F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" million")))
           .when(k % 6 == 2, F.concat((1 + k % 9).cast("string"), F.lit(".5 Billion")))
           .when(k % 6 == 3, F.concat(F.lit(" "), F.format_number(k, 0), F.lit(" ")))
           .when(k % 6 == 4, F.element_at(F.array(F.lit("n/a"), F.lit("12d"), F.lit("0x1p3"), F.lit("3e2")), (k % 4 + 1).cast("int")))
           .otherwise(F.lit("")))
    return o.select(k.alias("id"), raw.alias("raw")).select("id", "raw", S.parse_number("raw").alias("value"))


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def _month_name(d, short: bool):
    m = F.month(d)
    out = None
    for i, name in enumerate(MONTHS, start=1):
        label = name[:3] if short else name
        out = (F.when if out is None else out.when)(m == i, F.lit(label))
    return out


def q_parse_date(spark, sf_dir):
    o = _fx(spark, sf_dir)["orders"]
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    raw = (F.when(k % 6 == 0, d.cast("string"))
           .when(k % 6 == 1, F.concat(_month_name(d, False), F.lit(" "), day, F.lit(", "), year))
           .when(k % 6 == 2, F.concat(_month_name(d, True), F.lit(" "), day, F.lit(", "), year))
           .when(k % 6 == 3, F.concat(F.lpad(day, 2, "0"), F.lit("-"), _month_name(d, True), F.lit("-"), year))
           .when(k % 6 == 4, F.concat(F.lpad(F.month(d).cast("string"), 2, "0"), F.lit("/"),
                                      F.lpad(day, 2, "0"), F.lit("/"), year))
           .otherwise(F.lit("not a date")))
    return o.select(k.alias("id"), raw.alias("raw")).select("id", "raw", S.parse_date("raw").alias("parsed"))


def q_add_days(spark, sf_dir):
    f = _fx(spark, sf_dir)["fx_filings"]
    days = (F.when(F.col("id") % 4 == 0, 90).when(F.col("id") % 4 == 1, 180)
            .when(F.col("id") % 4 == 2, -30))
    raw = F.when(F.col("id") % 7 == 0, F.lit("to come")).otherwise(F.col("filing_date").cast("string"))
    return f.select("id", "filing_date", days.alias("days"), raw.alias("raw")).select(
        "id", "filing_date", "days", "raw", S.add_days("filing_date", "days").alias("shifted"),
        S.add_days("raw", "days").alias("shifted_text"))


def q_epoch_ms_to_date(spark, sf_dir):
    e = _fx(spark, sf_dir)["events"]
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    raw = (F.when(k % 9 == 0, F.lit("TBA")).when(k % 9 == 1, (-ms).cast("string"))
           .when(k % 9 == 2, (ms * 1000).cast("string")).otherwise(ms.cast("string")))
    return e.select(k.alias("event_id"), raw.alias("raw")).select(
        "event_id", "raw", S.epoch_ms_to_date("raw").alias("d"))


def q_filing_urls(spark, sf_dir):
    r = _fx(spark, sf_dir)["sec_filing_rows"]
    acc = F.when(F.col("row_key") % 23 == 0, F.lit("")).otherwise(F.col("accession_no"))
    return r.select("row_key", "cik", acc.alias("acc"), "primaryDocument").select(
        "row_key",
        S.filing_primary_doc_url("cik", "acc", F.nullif("primaryDocument", F.lit(""))).alias("primary_doc_url"),
        S.filing_index_url("cik", "acc").alias("filing_index_url"))


# ── Text ──────────────────────────────────────────────────────────────────────

def q_normalize_whitespace(spark, sf_dir):
    d = spread_small(_fx(spark, sf_dir)["documents"], "doc_id")
    return d.select("doc_id", TX.normalize_whitespace("text").alias("text"))


def q_html_to_text(spark, sf_dir):
    p = spread_small(_fx(spark, sf_dir)["pages"], "page_id")
    return p.select("page_id", TX.html_to_text("html").alias("text"))


def q_find_section(spark, sf_dir):
    d = spread_small(_fx(spark, sf_dir)["documents"], "doc_id")
    return d.select("doc_id", TX.find_section(F.col("text"), FIND_SECTION_TITLES).alias("section"))


def q_lockup_section(spark, sf_dir):
    return _texts(spark, sf_dir).select("filing_id", TX.lockup_section("text").alias("section"))


# ── Extractors (whole fixture texts) ──────────────────────────────────────────

def _texts(spark, sf_dir) -> DataFrame:
    """Fixture prospectus texts."""
    return _fx(spark, sf_dir)["fx_texts"]


def _offering(spark, sf_dir, *fields):
    return X.with_offering_fields(_texts(spark, sf_dir).select("filing_id", "text"), fields=list(fields)).drop("text")


def _lockup(spark, sf_dir, *fields):
    return X.with_lockup_fields(_texts(spark, sf_dir).select("filing_id", "text"), fields=list(fields)).drop("text")


def q_offer_price(spark, sf_dir):
    return _offering(spark, sf_dir, "offer_price")


def q_price_range(spark, sf_dir):
    return _offering(spark, sf_dir, "price_range_low", "price_range_high")


def q_shares_offered_total(spark, sf_dir):
    return _offering(spark, sf_dir, "shares_offered_direct").withColumnRenamed(
        "shares_offered_direct", "shares_offered_total")


def q_shares_primary_secondary(spark, sf_dir):
    return _offering(spark, sf_dir, "shares_primary", "shares_secondary")


def q_greenshoe_shares(spark, sf_dir):
    return _offering(spark, sf_dir, "greenshoe_shares")


def q_bookrunners(spark, sf_dir):
    return _offering(spark, sf_dir, "bookrunners")


def q_shares_post_ipo(spark, sf_dir):
    return _offering(spark, sf_dir, "shares_outstanding_post_ipo")


def q_shares_pre_ipo(spark, sf_dir):
    return _offering(spark, sf_dir, "shares_outstanding_pre_ipo")


def q_fully_diluted(spark, sf_dir):
    return _offering(spark, sf_dir, "fully_diluted_shares")


def q_lockup_days(spark, sf_dir):
    return _lockup(spark, sf_dir, "lockup_days")


def q_staged_unlock(spark, sf_dir):
    return _lockup(spark, sf_dir, "is_staged_unlock")


def q_unlock_notes(spark, sf_dir):
    return _lockup(spark, sf_dir, "unlock_notes")


def q_lockup_confidence(spark, sf_dir):
    return _lockup(spark, sf_dir, "lockup_days", "is_staged_unlock", "confidence")


# ── Sources ───────────────────────────────────────────────────────────────────

def _nasdaq_docs(fx: Fixtures) -> DataFrame:
    return L.land_nasdaq(fx["nasdaq_rows"])


def _nyse_docs(fx: Fixtures) -> DataFrame:
    return L.land_nyse(fx["nyse_rows"])


def q_nasdaq_candidates(spark, sf_dir):
    return CAL.nasdaq_candidates(_nasdaq_docs(_fx(spark, sf_dir)), _as_of())


def q_nyse_candidates(spark, sf_dir):
    return CAL.nyse_candidates(_nyse_docs(_fx(spark, sf_dir)))


def q_calendar_quarantine(spark, sf_dir):
    """The calendar pages set apart because they cannot be read."""
    fx = _fx(spark, sf_dir)
    pages = CAL.unreadable_nasdaq(_nasdaq_docs(fx)).unionByName(CAL.unreadable_nyse(_nyse_docs(fx)))
    return pages.select("source", "document", "reason")


def q_candidates_union(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return C.union_sources(CAL.nasdaq_candidates(_nasdaq_docs(fx), _as_of()),
                           CAL.nyse_candidates(_nyse_docs(fx)))


def _submissions(fx: Fixtures) -> DataFrame:
    return L.land_submissions(fx["sec_filing_rows"])


def q_target_filings(spark, sf_dir):
    return sec.submission_rows(_submissions(_fx(spark, sf_dir)))


def q_company_search(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    companies = sec.company_list_rows(L.land_company_list(fx["company_rows"]))
    return sec.search_companies(companies, fx["company_queries"])


def q_company_search_many(spark, sf_dir):
    """S4 with a query per customer, empty and one-letter ones, 20 results."""
    fx = _fx(spark, sf_dir)
    companies = sec.company_list_rows(L.land_company_list(fx["company_rows"]))
    return sec.search_companies(companies, fx["search_workload"], max_results=20)


def _best(fx: Fixtures) -> DataFrame:
    return FL.best_filing(fx["fx_filings"])


def q_document_join(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    b = _best(fx).select("issuer_id", F.col("id").alias("filing_id"), "primary_doc_url")
    j = sec.document_join(b, fx["raw_documents"], columns=("n_chars", "html"))
    return j.select("issuer_id", "filing_id", "primary_doc_url", "has_document",
                    F.col("n_chars").alias("html_chars"), F.sha2(F.col("html").cast("binary"), 256).alias("html_sha256"))


def q_fetch_worklist(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    needed = _best(fx).where(~F.col("is_parsed"))
    return sec.fetch_worklist(needed, fx["raw_documents"])


# ── Candidates (D1-D4, J1) ────────────────────────────────────────────────────

def q_candidate_dedup(spark, sf_dir):
    return C.dedup_candidates(_fx(spark, sf_dir)["fx_candidates"])


def q_issuer_match(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    m = C.match_issuers(C.dedup_candidates(fx["fx_candidates"]), fx["fx_issuers"])
    return m.select("source_rank", "ord", "company_name", "ticker", "issuer_id", "match_kind")


def q_issuer_match_patterns(spark, sf_dir):
    """D3 with wildcards in the candidates' names."""
    fx = _fx(spark, sf_dir)
    m = C.match_issuers(C.dedup_candidates(fx["wildcard_candidates"]), fx["fx_issuers"], patterns=True)
    return m.select("source_rank", "ord", "company_name", "ticker", "issuer_id", "match_kind")


def _discover(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return J.discover_candidates(fx["fx_issuers"], fx["fx_candidates"], as_of=_as_of())


def q_discover_from_calendars(spark, sf_dir):
    """J1 end to end: landed calendars (S1, S2) -> union -> dedup -> match ->
    fill/insert into the stored issuers."""
    fx = _fx(spark, sf_dir)
    res = J.discover_candidates(fx["fx_issuers"], CAL.nasdaq_candidates(_nasdaq_docs(fx), _as_of()),
                                CAL.nyse_candidates(_nyse_docs(fx)), as_of=_as_of())
    return res.tables["issuers"]


def q_issuer_upsert(spark, sf_dir):
    return _discover(spark, sf_dir).tables["issuers"]


def q_discover_stats(spark, sf_dir):
    return _discover(spark, sf_dir).stats


# ── Filings (D5, D8, D10, J2) ─────────────────────────────────────────────────

def q_best_filing(spark, sf_dir):
    b = _best(_fx(spark, sf_dir))
    return b.select("issuer_id", F.col("id").alias("filing_id"), "form_type", "filing_date", "primary_doc_url")


def _sync(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    stored = fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
    stored = stored.withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS)
    return J.sync_sec_filings(fx["fx_issuers"], stored, _submissions(fx))


def q_filing_sync(spark, sf_dir):
    return _sync(spark, sf_dir).tables["new_filings"]


def _ingest(spark, sf_dir):
    """The landed submissions arrive as files, a stream ingests them in
    several micro-batches against the stored filings.  Returns the fixtures,
    the stored filings and the folder of the run."""
    import uuid

    from floatline.session import ensure_checkpoint_dir
    from floatline.streaming.ingest import ingest_filings
    fx = _fx(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    stored = fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
    stored = stored.withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS)
    stored.write.parquet(f"{root}/filings")
    docs = materialize(_submissions(fx))
    n_docs, writers = docs.count(), 8 * parallelism(spark)
    n_files = max(4, n_docs // LANDED_DOCS_PER_FILE)
    if n_files > writers:  # a task writes several files: no task, and no part of a shuffle, for each
        n_files += writers  # the last one of a task is shorter
    docs.repartition(min(n_files, writers), "cik10", "page").write.option("maxRecordsPerFile", LANDED_DOCS_PER_FILE).parquet(f"{root}/landing")
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/_checkpoint", fx["fx_issuers"],
                   files_per_batch=-(-n_files // 4), transitions_dir=f"{root}/transitions", failures_dir=f"{root}/failures",
                   state_partitions=parallelism(spark))
    return fx, stored, root


def q_filing_sync_incremental(spark, sf_dir):
    """The rows appended equal the batch sync (ids aside: they follow batch order)."""
    _, stored, root = _ingest(spark, sf_dir)
    appended = spark.read.parquet(f"{root}/filings").join(stored.select("id"), "id", "left_anti")
    return appended.drop("id")


def q_status_transition_incremental(spark, sf_dir):
    """Statuses after the last micro-batch (must equal ``status_transition``)."""
    fx, _, root = _ingest(spark, sf_dir)
    log = spark.read.parquet(f"{root}/transitions").groupBy("issuer_id").agg(F.max_by("new_status", "batch").alias("new_status"))
    old = fx["fx_issuers"].select(F.col("id").alias("issuer_id"), F.col("status").alias("old_status"))
    return old.join(log, "issuer_id").select("issuer_id", "old_status", "new_status",
                                             (~F.col("old_status").eqNullSafe(F.col("new_status"))).alias("changed"))


def q_sync_failures_incremental(spark, sf_dir):
    """The unreadable documents that the micro-batches met."""
    _, _, root = _ingest(spark, sf_dir)
    return spark.read.parquet(f"{root}/failures").select("issuer_id", "cik10", F.col("page").cast("long").alias("page"), "reason")


def q_status_transition(spark, sf_dir):
    return _sync(spark, sf_dir).tables["transitions"]


def q_sync_failures(spark, sf_dir):
    return _sync(spark, sf_dir).tables["failures"]


def q_sync_quarantine(spark, sf_dir):
    """The submissions documents set apart because they cannot be read."""
    return _sync(spark, sf_dir).tables["quarantine"].select("source", "document", "reason")


def q_sync_stats(spark, sf_dir):
    return _sync(spark, sf_dir).stats


# ── Parse jobs (D6, D7, D11-D15, J3, J4) ──────────────────────────────────────

def _offering_job(spark, sf_dir, force=False):
    fx = _fx(spark, sf_dir)
    return J.parse_offering_data(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"],
                                 fx["fx_offerings"], fx["fx_capitalization"], _as_of(), force=force)


def _lockup_job(spark, sf_dir, force=False):
    fx = _fx(spark, sf_dir)
    return J.parse_lockups(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"],
                           fx["fx_lockups"], _as_of(), force=force)


def q_parse_worklist(spark, sf_dir):
    return _offering_job(spark, sf_dir).tables["worklist"]


def q_run_stats(spark, sf_dir):
    return _offering_job(spark, sf_dir).stats


def q_derived_measures(spark, sf_dir):
    f = _offering_job(spark, sf_dir).tables["fields"]
    return f.select("issuer_id", "filing_id", "shares_offered_total", "gross_proceeds", "float_ratio")


def q_offering_upsert(spark, sf_dir):
    return _offering_job(spark, sf_dir).tables["offerings"]


def q_capitalization_upsert(spark, sf_dir):
    return _offering_job(spark, sf_dir).tables["capitalization"]


def q_mark_parsed(spark, sf_dir):
    return _offering_job(spark, sf_dir).tables["filings"].select("id", "is_parsed")


def q_lockup_upsert(spark, sf_dir):
    return _lockup_job(spark, sf_dir).tables["lockups"]


def q_lockup_upsert_force(spark, sf_dir):
    return _lockup_job(spark, sf_dir, force=True).tables["lockups"]


def q_lockup_run_stats(spark, sf_dir):
    return _lockup_job(spark, sf_dir).stats


def q_lockup_dates(spark, sf_dir):
    f = _lockup_job(spark, sf_dir).tables["fields"]
    return f.select("issuer_id", "filing_id", "lockup_days", "lockup_start_date", "lockup_end_date")


def q_constraint_violations(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return constraint_violations(fx["bad_issuers"], fx["bad_filings"], fx["bad_offerings"],
                                 fx["bad_capitalization"], fx["bad_lockups"])


# ── Reports (R1-R4) ───────────────────────────────────────────────────────────

def q_upcoming_ipos(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return R.upcoming_ipos(fx["fx_issuers"], fx["fx_filings"], fx["fx_offerings"], _as_of())


def q_recent_ipos(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return R.recent_ipos(fx["fx_issuers"], fx["fx_offerings"], fx["fx_capitalization"],
                         fx["fx_lockups"], _as_of())


def q_upcoming_unlocks(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return R.upcoming_unlocks(fx["fx_issuers"], fx["fx_offerings"], fx["fx_filings"],
                              fx["fx_lockups"], _as_of())


def q_latest_per_issuer(spark, sf_dir):
    o = _fx(spark, sf_dir)["fx_offerings"]
    return R.latest_per_issuer(o).select("issuer_id", F.col("id").alias("offering_id"), "parsed_at", "offer_price")


def q_issuer_state_merged(spark, sf_dir):
    """D8, D10 and R4 from the stored state: states of the filings and
    offerings before a day are stored, then later ones are merged in by two runs."""
    import uuid

    from floatline.operators import issuer_state as ST
    from floatline.session import ensure_checkpoint_dir
    fx = _fx(spark, sf_dir)
    f, o, day = fx["fx_filings"], fx["fx_offerings"], F.lit(SYNC_STORED_BEFORE).cast("date")
    cols = ["id", "parsed_at", "offer_price"]
    stored = ST.day_states(f.where(F.col("filing_date") < day), o.where(F.col("parsed_at") < day), cols)
    states = ST.IssuerStates(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/issuer-states-{uuid.uuid4().hex}", stored.schema)
    states.create(stored)
    for early in (True, False):
        def arrives(date):
            return (F.col(date) >= day) & ((F.dayofmonth(date) <= 15) == F.lit(early))
        states.merge(ST.day_states(f.where(arrives("filing_date")), o.where(arrives("parsed_at")), cols))
    s = states.read().drop("bucket")
    status = ST.state_status(s, fx["fx_issuers"]).select("issuer_id", "new_status")
    return s.join(status, "issuer_id", "left").select(
        "issuer_id", "new_status", F.col("best.v.id").alias("best_id"), F.col("best.v.form_type").alias("best_form"),
        F.col("best.v.filing_date").alias("best_date"), F.col("latest_filing.v.id").alias("latest_filing_id"),
        F.col("latest_offering.v.id").alias("latest_offering_id"), F.col("latest_offering.v.offer_price").alias("latest_offer_price"))


def q_report_counts(spark, sf_dir):
    """K2: rows per exported report (the three reports at the report date)."""
    from floatline.sinks.csv import row_counts
    fx = _fx(spark, sf_dir)
    return row_counts(J.export_reports({
        "issuers": fx["fx_issuers"], "filings": fx["fx_filings"], "offerings": fx["fx_offerings"],
        "capitalization": fx["fx_capitalization"], "lockups": fx["fx_lockups"]}, _as_of()))


def q_report_csv(spark, sf_dir):
    """K1: a report written as CSV and read back; names hold commas and quotes."""
    import uuid

    from floatline.session import ensure_checkpoint_dir
    from floatline.sinks.csv import read_report, write_report
    report = q_recent_ipos(spark, sf_dir).withColumn("company_name", F.concat("company_name", F.lit(', "the" Inc.')))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}.csv"
    write_report(report, path)
    return read_report(spark, path, report.schema)


def q_daily_unlocks(spark, sf_dir):
    """Flagship: best filing -> document text -> lock-up fields -> upsert ->
    lock-ups ending in the next 30 days."""
    fx = _fx(spark, sf_dir)
    lk = _lockup_job(spark, sf_dir).tables["lockups"]
    return R.upcoming_unlocks(fx["fx_issuers"], fx["fx_offerings"], fx["fx_filings"], lk, _as_of())


def q_daily_shared_unlocks(spark, sf_dir):
    """The daily parse with one text table for J3 and J4 -> upcoming unlocks
    (must equal ``daily_unlocks``)."""
    from floatline.plans.daily import parse_filings
    fx = _fx(spark, sf_dir)
    out = parse_filings(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"], fx["fx_offerings"],
                        fx["fx_capitalization"], fx["fx_lockups"], _as_of())
    return R.upcoming_unlocks(fx["fx_issuers"], fx["fx_offerings"], fx["fx_filings"], out["lockups"], _as_of())


def q_daily_upcoming_ipos(spark, sf_dir):
    """Offering parse -> upsert -> upcoming listings report on the new state."""
    fx = _fx(spark, sf_dir)
    off = _offering_job(spark, sf_dir).tables["offerings"]
    return R.upcoming_ipos(fx["fx_issuers"], fx["fx_filings"], off, _as_of())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
