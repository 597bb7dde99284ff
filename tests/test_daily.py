"""The daily run shares one text table between J3 and J4 and gives the same
tables as the two jobs run separately."""

import glob

from pyspark.sql import functions as F

from floatline.operators import filings as FL
from floatline.plans import daily, jobs as J
from floatline.plans.catalog import SYNC_STORED_BEFORE, _submissions
from floatline.sinks.snapshots import versions
from floatline.sources.fixtures import AS_OF, Fixtures
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shared_parse_equals_separate_jobs(spark):
    fx = Fixtures(spark, SF001)
    as_of = F.lit(AS_OF).cast("date")
    both = daily.parse_filings(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"], fx["fx_offerings"],
                               fx["fx_capitalization"], fx["fx_lockups"], as_of)
    j3 = J.parse_offering_data(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"],
                               fx["fx_offerings"], fx["fx_capitalization"], as_of)
    j4 = J.parse_lockups(fx["fx_issuers"], fx["fx_filings"], fx["raw_documents"], fx["fx_lockups"], as_of)
    assert _rows(both["offerings"]) == _rows(j3.tables["offerings"])
    assert _rows(both["capitalization"]) == _rows(j3.tables["capitalization"])
    assert _rows(both["lockups"]) == _rows(j4.tables["lockups"])
    assert _rows(both["filings"]) == _rows(j3.tables["filings"])
    assert tuple(both["lockup_stats"].first()) == tuple(j4.stats.first())


def test_daily_run_writes_snapshots_and_reports(spark, tmp_path):
    fx = Fixtures(spark, SF001)
    stored = (fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
              .withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS))
    tables = {"issuers": fx["fx_issuers"], "filings": stored, "offerings": fx["fx_offerings"],
              "capitalization": fx["fx_capitalization"], "lockups": fx["fx_lockups"]}
    out = daily.daily_run(tables, fx["raw_documents"], _submissions(fx), AS_OF,
                          snapshot_dir=str(tmp_path / "tables"), export_dir=str(tmp_path / "exports"))
    assert out["tables"]["filings"].count() > stored.count()
    for name in daily.TABLES:
        assert versions(spark, str(tmp_path / "tables" / name)) == [1]
    assert len(glob.glob(str(tmp_path / "exports" / "*" / "part-*.csv"))) == 3
    assert out["reports"]["upcoming_ipos.csv"].count() > 0
