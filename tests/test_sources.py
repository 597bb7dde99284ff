"""S1-S4 readers on small hand-written payloads."""

import json

from pyspark.sql import functions as F

from floatline.sources import calendars as CAL
from floatline.sources import sec


def _nasdaq_doc(priced=(), upcoming=(), filed=(), withdrawn=()):
    rows = lambda rs, key: [dict(r, **{key: "01/02/2024"}) for r in rs]
    return json.dumps({"data": {"priced": {"rows": rows(priced, "pricedDate")},
                                "upcoming": {"upcomingTable": {"rows": rows(upcoming, "expectedPriceDate")}},
                                "filed": {"rows": rows(filed, "filedDate")},
                                "withdrawn": {"rows": list(withdrawn)}}})


def test_nasdaq_dedup_and_window(spark):
    a = {"dealID": "1", "companyName": " Alpha ", "proposedTickerSymbol": " ALP ", "proposedExchange": ""}
    b = {"dealID": "2", "companyName": "Beta", "proposedTickerSymbol": "", "proposedExchange": "NASDAQ"}
    nodeal = {"companyName": "NoId One"}
    nodeal2 = {"dealID": None, "companyName": "NoId Two"}
    docs = spark.createDataFrame([
        ("2024-01", 0, _nasdaq_doc(priced=[a], filed=[nodeal])),
        ("2024-02", 0, _nasdaq_doc(upcoming=[dict(a, companyName="Alpha later"), b, nodeal2],
                                   withdrawn=[{"dealID": "9", "companyName": "Gone"}])),
        ("2023-11", 0, _nasdaq_doc(priced=[{"dealID": "7", "companyName": "Too early"}])),
        ("2024-04", 0, _nasdaq_doc(priced=[{"dealID": "8", "companyName": "Too late"}]))],
        "month string, page long, json string")
    out = CAL.nasdaq_candidates(docs, F.lit("2024-01-20").cast("date")).orderBy("ord").collect()
    assert [(r.company_name, r.ticker, r.exchange) for r in out] == [
        ("Alpha", "ALP", None), ("NoId One", None, None), ("Beta", None, "NASDAQ")]
    assert out[0].source_url.endswith("/ipos") and out[0].raw_date_text == "01/02/2024"


def test_nyse_rows(spark):
    doc = json.dumps({"calendarList": [
        {"issuer_nm": " Gamma ", "symbol": " GAM ", "custom_group_exchange_nm": "NYSE",
         "deal_status_flg": "P", "price_dt": "1710460800000", "init_file_dt": "1700000000000"},
        {"issuer_nm": "Gone", "deal_status_flg": "W"},
        {"issuer_nm": "Delta", "symbol": "", "deal_status_flg": None,
         "price_dt": "4102444800001", "init_file_dt": "1700000000000"},
        {"issuer_nm": "Eps", "price_dt": "TBA"}]})
    docs = spark.createDataFrame([(0, doc)], "page long, json string")
    out = CAL.nyse_candidates(docs).orderBy("ord").collect()
    assert [(r.company_name, r.ticker, r.exchange, r.raw_date_text) for r in out] == [
        ("Gamma", "GAM", "NYSE", "2024-03-15"), ("Delta", None, None, "2023-11-14"), ("Eps", None, None, None)]


def test_submissions_zip_pads_and_filters(spark):
    doc = json.dumps({"cik": "320193", "filings": {"recent": {
        "accessionNumber": ["0000320193-24-000001", "0000320193-24-000002", "0000320193-24-000003"],
        "form": ["S-1", "10-K", "424B4"],
        "filingDate": ["2024-01-01", "2024-02-01", "2024-03-01"],
        "primaryDocument": ["s1.htm", ""]}}})
    docs = spark.createDataFrame([("0000320193", 0, doc)], "cik10 string, page long, json string")
    rows = sec.submission_rows(docs).orderBy("pos").collect()
    assert [(r.pos, r.form_type, r.primary_doc) for r in rows] == [(0, "S-1", "s1.htm"), (2, "424B4", None)]
    assert rows[0].primary_doc_url.endswith("/320193/000032019324000001/s1.htm")
    assert rows[1].primary_doc_url is None and rows[1].filing_index_url.endswith("000032019324000003/")


def test_company_list_search(spark):
    doc = json.dumps({"fields": ["cik", "name", "ticker", "exchange"],
                      "data": [[320193, "Apple Inc.", "AAPL", "Nasdaq"], [1713445, "Reddit, Inc.", "RDDT", "NYSE"],
                               [1, "Pineapple Co", "PINE", None], [None, "Apple Pie", None, None]]})
    docs = spark.createDataFrame([(0, doc)], "page long, json string")
    comps = sec.company_list_rows(docs)
    q = spark.createDataFrame([("a", "apple"), ("b", "rddt"), ("c", "Inc.")], "query_id string, query string")
    got = sorted((r.query_id, r.rank, r.cik, r.name) for r in sec.search_companies(comps, q, max_results=10).collect())
    assert got == [("a", 1, "0000320193", "Apple Inc."), ("a", 2, "0000000001", "Pineapple Co"),
                   ("a", 3, "0000000000", "Apple Pie"),
                   ("b", 1, "0001713445", "Reddit, Inc."),
                   ("c", 1, "0000320193", "Apple Inc."), ("c", 2, "0001713445", "Reddit, Inc.")]


def test_company_grams_do_not_go_through_the_driver(spark, monkeypatch):
    from floatline.operators import partitioning
    comps = spark.sql("SELECT 0L page, id pos, string(id) cik, concat('Name ', id) name, concat('T', id) ticker, 'X' exchange FROM range(40)")
    q = spark.sql("SELECT concat('q', id) query_id, concat('name ', id) query FROM range(12) UNION ALL VALUES ('e', ''), ('s', 'n'), ('t', 't5')")
    rows, plans = [], []
    for limit in (partitioning.SMALL_ROWS, 0):
        monkeypatch.setattr(partitioning, "SMALL_ROWS", limit)
        found = sec.search_companies(comps, q, max_results=3)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        rows.append(sorted(tuple(r) for r in found.collect()))
    assert rows[0] == rows[1] and len(rows[0]) == (1 + 3 * 3 + 6 + 2) + 3 + 3 + 1
    # of many queries only the first companies, which empty queries get, are sent to every task
    assert plans[1].count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in plans[1]
