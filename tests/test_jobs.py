"""Table operators and jobs: quirks of matching, status, worklists, and
idempotence (a second run changes nothing)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floatline.operators import candidates as C
from floatline.operators import filings as FL
from floatline.operators import upserts as U
from floatline.plans import jobs as J
from floatline.plans.catalog import SYNC_STORED_BEFORE, _submissions
from floatline.sources.fixtures import AS_OF, Fixtures
from tests.conftest import SF001

ISSUER_SCHEMA = "id long, company_name string, cik string, ticker string, exchange string, status string, source_url string"
CAND_SCHEMA = "source_rank int, ord long, company_name string, ticker string, exchange string, source_url string"


def test_dedup_keeps_first_and_drops_blank(spark):
    c = spark.createDataFrame([(0, 2, "Acme", "ab", None, None), (0, 1, " acme ", "AB ", "X", None),
                               (1, 0, "  ", "Q", None, None), (1, 5, "Beta", None, None, None)], CAND_SCHEMA)
    out = sorted((r.ord, r.company_name) for r in C.dedup_candidates(c).collect())
    assert out == [(1, " acme "), (5, "Beta")]


def test_match_is_snapshot_and_ticker_case_sensitive(spark):
    issuers = spark.createDataFrame([(1, "Acme", None, "ACM", "", "candidate", None)], ISSUER_SCHEMA)
    c = spark.createDataFrame([(0, 1, "Acme Two", "acm", None, None),     # ticker differs in case
                               (0, 2, "New Co", "NEW", "Nasdaq", None),
                               (0, 3, "Newer Co", "NEW", None, None),     # same ticker, both new
                               (0, 4, "acme", None, "NYSE", "u1"),        # name match, fills
                               (0, 5, "ACME", "ZZ", "NASDAQ", "u2")],     # adds only ticker
                              CAND_SCHEMA)
    m = C.match_issuers(c, issuers)
    kinds = {r.ord: (r.issuer_id, r.match_kind) for r in m.collect()}
    assert kinds[1] == (None, None) and kinds[2] == (None, None) and kinds[3] == (None, None)
    assert kinds[4] == (1, "name") and kinds[5] == (1, "name")
    new_issuers, actions = C.upsert_issuers(m, issuers)
    acts = {r.ord: r.action for r in actions.collect()}
    assert acts == {1: "inserted", 2: "inserted", 3: "inserted", 4: "updated", 5: "skipped"}
    got = {r.id: r for r in new_issuers.collect()}
    assert (got[1].exchange, got[1].ticker, got[1].source_url) == ("NYSE", "ACM", "u1")
    assert sorted(got) == [1, 2, 3, 4]
    assert got[3].company_name == "New Co" and got[4].company_name == "Newer Co"


def test_status_machine(spark):
    issuers = spark.createDataFrame(
        [(1, "a", "1", None, None, "priced", None), (2, "b", "2", None, None, "candidate", None),
         (3, "c", "3", None, None, "withdrawn", None), (4, "d", "4", None, None, None, None),
         (5, "e", "5", None, None, "trading", None), (6, "f", "6", None, None, "filed", None)], ISSUER_SCHEMA)
    found = spark.createDataFrame(
        [(1, "x1", "RW"), (2, "x2", "S-1"), (3, "x3", "424B4"), (4, "", "S-1"), (5, "x5", "F-1"),
         (6, "x6", "S-1/A")], "issuer_id long, accession_no string, form_type string")
    t = {r.issuer_id: (r.new_status, r.changed) for r in FL.derive_status(found, issuers).collect()}
    assert t == {1: ("withdrawn", True), 2: ("filed", True), 3: ("withdrawn", False),
                 4: ("candidate", True), 5: ("trading", False), 6: ("filed", False)}


def test_derived_measures_zero_is_missing(spark):
    df = spark.createDataFrame([(10.0, None, 5.0, 5.0, 100.0), (0.0, 7.0, None, None, 0.0),
                                (None, None, 3.0, None, 6.0)],
                               "p double, t double, a double, b double, post double")
    total, gross, ratio = U.derived_measures(F.col("p"), F.col("t"), F.col("a"), F.col("b"), F.col("post"))
    rows = [tuple(r) for r in df.select(total, gross, ratio).collect()]
    assert rows == [(10.0, 100.0, 0.1), (7.0, None, None), (3.0, None, 0.5)]


def test_best_filing_has_no_second_choice(spark):
    issuers = spark.createDataFrame([(1, "a", None, None, None, "filed", None)], ISSUER_SCHEMA)
    filings = spark.createDataFrame(
        [(10, 1, "424B4", dt.date(2024, 3, 1), None, False), (11, 1, "S-1", dt.date(2024, 1, 1), "u11", False)],
        "id long, issuer_id long, form_type string, filing_date date, primary_doc_url string, is_parsed boolean")
    docs = spark.createDataFrame([("u11", "<p>x</p>")], "url string, html string")
    [w] = FL.parse_worklist(issuers, filings, docs).collect()
    assert (w.filing_id, w.outcome, w.reason) == (10, "skipped", "no_url")


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF001)


def test_filing_sync_is_idempotent(spark, fx):
    stored = (fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
              .withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS))
    first = J.sync_sec_filings(fx["fx_issuers"], stored, _submissions(fx))
    inserted = first.tables["new_filings"].count()
    assert inserted > 0
    again = J.sync_sec_filings(fx["fx_issuers"], first.tables["filings"], _submissions(fx))
    assert again.tables["new_filings"].count() == 0
    s = again.stats.first()
    assert s.filings_inserted == 0 and s.filings_skipped > 0


def test_parse_jobs_are_idempotent(spark, fx):
    as_of = F.lit(AS_OF).cast("date")
    r1 = J.parse_offering_data(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"],
                               fx["fx_offerings"], fx["fx_capitalization"], as_of)
    assert r1.stats.first().parsed > 0
    r2 = J.parse_offering_data(fx["fx_issuers"], r1.tables["filings"], fx["raw_documents"],
                               r1.tables["offerings"], r1.tables["capitalization"], as_of)
    assert r2.stats.first().parsed == 0
    assert r2.tables["offerings"].count() == r1.tables["offerings"].count()
    l1 = J.parse_lockups(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"], fx["fx_lockups"], as_of)
    l2 = J.parse_lockups(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"], l1.tables["lockups"], as_of)
    assert l1.stats.first().parsed > 0 and l2.stats.first().parsed == 0
    assert l2.tables["lockups"].count() == l1.tables["lockups"].count()


def test_discover_is_idempotent(spark, fx):
    r1 = J.discover_candidates(fx["fx_issuers"], fx["fx_candidates"])
    assert r1.stats.first().inserted > 0
    issuers = r1.tables["issuers"].checkpoint()
    r2 = J.discover_candidates(issuers, fx["fx_candidates"])
    s = r2.stats.first()
    assert s.inserted == 0 and s.updated == 0


def test_duplicate_key_in_one_document_inserted_once(spark):
    found = spark.createDataFrame(
        [(1, "a1", "S-1", "2024-01-02", "u1", "i1", 0, 0), (1, "a1", "S-1", "2024-01-02", "u2", "i1", 0, 3),
         (1, "a2", "RW", "", None, "", 0, 1), (1, "", "S-1", "2024-01-01", None, "", 0, 2)],
        "issuer_id long, accession_no string, form_type string, filing_date string, "
        "primary_doc_url string, filing_index_url string, page long, pos int")
    stored = spark.createDataFrame([(7, 1, "zz", "S-1", dt.date(2020, 1, 1), None, None, False)],
                                   "id long, issuer_id long, accession_no string, form_type string, "
                                   "filing_date date, primary_doc_url string, filing_index_url string, is_parsed boolean")
    rows, counts = FL.sync_filings(found, stored)
    got = sorted((r.id, r.accession_no, r.primary_doc_url, r.filing_date) for r in rows.collect())
    # '' date sorts last in the job order; the repeated key keeps its first row
    assert got == [(8, "a1", "u1", dt.date(2024, 1, 2)), (9, "a2", None, None)]
    [c] = counts.collect()
    assert (c.inserted, c.skipped) == (2, 1)


def test_lockup_job_ignores_is_parsed_and_offering_dates_stay_empty(spark):
    issuers = spark.createDataFrame([(1, "a", None, None, "NYSE", "filed", None)], ISSUER_SCHEMA)
    filings = spark.createDataFrame(
        [(10, 1, "424B4", dt.date(2024, 3, 1), "u10", True)],
        "id long, issuer_id long, form_type string, filing_date date, primary_doc_url string, is_parsed boolean")
    docs = spark.createDataFrame([("u10", "<p>Lock-Up Agreements. We agreed not to sell for a period of "
                                          "180 days after the date of this prospectus. Price to the public $12.00 "
                                          "per share.</p>")], "url string, html string")
    empty_lk = spark.createDataFrame([], "id long, issuer_id long, filing_id long, lockup_days int, "
                                         "lockup_start_date date, lockup_end_date date, is_staged_unlock boolean, "
                                         "unlock_notes string, unlock_shares_estimate double, confidence string, "
                                         "parsed_at date")
    lk = J.parse_lockups(issuers, filings, docs, empty_lk, "2024-03-10")
    [row] = lk.tables["lockups"].collect()
    assert (row.lockup_days, row.lockup_end_date, row.confidence) == (180, dt.date(2024, 8, 28), "high")
    # the offering job honours is_parsed; with force it parses, and never writes pricing dates
    stored_off = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in [
        ("id", "long"), ("issuer_id", "long"), ("filing_id", "long"), ("source_form_type", "string"),
        ("offer_price", "double"), ("pricing_date", "date"), ("expected_trade_date", "date"),
        ("price_range_low", "double"), ("price_range_high", "double"), ("shares_offered_total", "double"),
        ("shares_primary", "double"), ("shares_secondary", "double"), ("greenshoe_shares", "double"),
        ("gross_proceeds", "double"), ("bookrunners", "string"), ("exchange", "string"), ("parsed_at", "date")]))
    stored_cap = spark.createDataFrame([], "id long, issuer_id long, filing_id long, shares_outstanding_pre_ipo double, "
                                           "shares_outstanding_post_ipo double, free_float_at_ipo double, "
                                           "float_ratio double, fully_diluted_shares double, parsed_at date")
    off = J.parse_offering_data(issuers, filings, docs, stored_off, stored_cap, "2024-03-10")
    assert off.stats.first().parsed == 0
    off = J.parse_offering_data(issuers, filings, docs, stored_off, stored_cap, "2024-03-10", force=True)
    [o] = off.tables["offerings"].collect()
    assert (o.offer_price, o.pricing_date, o.expected_trade_date, o.exchange) == (12.0, None, None, "NYSE")
