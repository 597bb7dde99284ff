"""Driver contract: entry() runs; a sample of queries equals its DuckDB oracle."""

import pytest

import __spark_entry__ as E
from floatline.plans.catalog import QUERIES
from floatline.plans.reports import UPCOMING_UNLOCKS_COLS
from tests.conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == UPCOMING_UNLOCKS_COLS
    assert df.count() > 0


def test_every_query_has_an_oracle():
    # (the removable training-data queries have SQL only where SQL can express them)
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["best_filing", "bookrunners", "lockup_days", "issuer_upsert",
                                  "filing_sync", "upcoming_unlocks", "nasdaq_candidates", "html_to_text",
                                  "company_search_many", "report_csv", "sync_failures", "constraint_violations",
                                  "status_transition_incremental", "add_days", "parse_number", "document_join"])
def test_query_matches_oracle(spark, name):
    from tools.check_oracle import digest, duck_connect
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = duck_connect(SF001).execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
