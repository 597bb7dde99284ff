"""Unreadable landed documents (S1-S3, D15, J2): what counts as one, and what it costs."""

import json

import pytest
from pyspark.sql import functions as F

from floatline.plans.jobs import sync_sec_filings
from floatline.sources import calendars as CAL
from floatline.sources import sec
from floatline.sources.payloads import parsed, quarantine

GOOD = json.dumps({"cik": "1", "filings": {"recent": {"accessionNumber": ["a-1"], "form": ["S-1"],
                                                       "filingDate": ["2001-01-02"], "primaryDocument": ["d.htm"]}}})
READABLE = [GOOD, "{}", '{"filings": null}', '{"cik": "1"}', '{"filings": {"recent": {}}}', " " + GOOD + "\n"]
UNREADABLE = [None, "", " ", "null", "[]", f"[{GOOD}]", '"text"', "12", "<html>", GOOD[:-1], GOOD[:40], GOOD + " x", GOOD + GOOD,
              GOOD + "}", '{"filings": "x"}', '{"filings": {"recent": "x"}}', '{"filings": {"recent": {"form": "S-1"}}}', '{"cik": "1",}']


def landed(spark, texts):
    return spark.createDataFrame([("%010d" % (i + 1), 0, t) for i, t in enumerate(texts)], "cik10 string, page long, json string")


def test_what_is_unreadable(spark):
    rows = parsed(landed(spark, READABLE + UNREADABLE), sec.SUBMISSIONS_SCHEMA, "cik10").collect()
    got = {int(r["cik10"]) - 1: r["unreadable"] for r in rows}
    assert [got[i] for i in range(len(got))] == [False] * len(READABLE) + [True] * len(UNREADABLE)
    assert all((r["d"] is None) == r["unreadable"] for r in rows)


def test_quarantine_holds_the_documents_as_they_landed(spark):
    rows = quarantine(landed(spark, READABLE + UNREADABLE), sec.SUBMISSIONS_SCHEMA, "submissions", "cik10", "page").collect()
    assert {r["json"] for r in rows} == set(UNREADABLE) and len(rows) == len(UNREADABLE)
    assert {r["source"] for r in rows} == {"submissions"} and {r["reason"] for r in rows} == {"unreadable_document"}
    assert all(r["document"].endswith("/0") and r["n_chars"] == len(r["json"] or "") for r in rows)


@pytest.mark.parametrize("bad", ["", GOOD[:-9], "[]"])
def test_sync_counts_the_issuer_as_failed_and_the_others_go_on(spark, bad):
    issuers = spark.createDataFrame([(1, "1", "candidate"), (2, "2", "candidate"), (3, "3", "candidate"), (4, "x", None)],
                                    "id long, cik string, status string")
    docs = spark.createDataFrame([("%010d" % 1, 0, GOOD), ("%010d" % 2, 0, bad), ("%010d" % 2, 1, GOOD.replace("a-1", "b-1")),
                                  ("%010d" % 2, 2, bad)], "cik10 string, page long, json string")
    filings = spark.createDataFrame([], "id long, issuer_id long, accession_no string, form_type string, filing_date date, "
                                        "primary_doc_url string, filing_index_url string, is_parsed boolean")
    out = sync_sec_filings(issuers, filings, docs)
    assert out.stats.first().asDict() == {"issuer_count": 4, "filings_inserted": 2, "filings_skipped": 0, "filings_failed": 3}
    assert {tuple(r) for r in out.tables["failures"].select("issuer_id", "reason").collect()} == {
        (2, "unreadable_document"), (3, "no_document"), (4, "invalid_cik")}
    assert {r["accession_no"] for r in out.tables["new_filings"].collect()} == {"a-1", "b-1"}
    assert out.tables["quarantine"].count() == 2
    assert {r["issuer_id"] for r in out.tables["transitions"].where("changed").collect()} == {1, 2}


def test_a_calendar_page_that_fails_drops_only_itself(spark):
    page = json.dumps({"data": {"priced": {"rows": [{"dealID": "D1", "companyName": "One"}]}, "upcoming": {"upcomingTable": None}}})
    other = page.replace("D1", "D2").replace("One", "Two")
    docs = spark.createDataFrame([("2001-06", 0, page), ("2001-06", 1, other[:-5]), ("2001-07", 0, other), ("2001-07", 1, "[]")],
                                 "month string, page long, json string")
    as_of = F.lit("2001-06-15").cast("date")
    assert {r["company_name"] for r in CAL.nasdaq_candidates(docs, as_of).collect()} == {"One", "Two"}
    assert {r["document"] for r in CAL.unreadable_nasdaq(docs).collect()} == {"2001-06/1", "2001-07/1"}
    nyse = json.dumps({"calendarList": [{"issuer_nm": "Three"}]})
    docs = spark.createDataFrame([(0, nyse), (1, nyse + "!"), (2, "")], "page long, json string")
    assert [r["company_name"] for r in CAL.nyse_candidates(docs).collect()] == ["Three"]
    assert {r["document"] for r in CAL.unreadable_nyse(docs).collect()} == {"1", "2"}


def test_payloads_are_parsed_once(spark):
    docs = landed(spark, [GOOD])
    plan = sec.submission_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    pages = spark.createDataFrame([("2001-06", 0, "{}")], "month string, page long, json string")
    plan = CAL.nasdaq_rows(pages, F.lit("2001-06-15").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
