"""K1-K3 sinks and T1 incremental ingest."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from floatline.operators import filings as FL
from floatline.plans.catalog import SYNC_STORED_BEFORE, _submissions
from floatline.sinks import csv as K
from floatline.sinks.snapshots import read_latest, versions, write_snapshot
from floatline.sources.fixtures import Fixtures
from floatline.streaming import ingest
from floatline.streaming.ingest import ingest_filings
from tests.conftest import SF001


def test_report_csv(spark, tmp_path):
    df = spark.createDataFrame([("Acme", 34.0, True, None), ("Beta", None, False, "x")],
                               "company_name string, offer_price double, is_staged_unlock boolean, note string")
    out = K.export({"r.csv": df.orderBy("company_name")}, str(tmp_path))
    assert out["row_counts"] == {"r.csv": 2}
    [part] = glob.glob(os.path.join(out["exported_files"][0], "part-*.csv"))
    rows = list(csv.reader(open(part)))
    assert rows == [["company_name", "offer_price", "is_staged_unlock", "note"],
                    ["Acme", "34.0", "True", ""], ["Beta", "", "False", "x"]]


def test_export_runs_each_report_once_and_counts_what_it_wrote(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def noted(part):
        runs.add(1)
        yield from part
    one = spark.createDataFrame(spark.range(40, numPartitions=1).rdd.mapPartitions(noted), "id long")
    empty = spark.range(0).where("id > 5")
    out = K.export({"one.csv": one, "none.csv": empty}, str(tmp_path))
    assert out["row_counts"] == {"one.csv": 40, "none.csv": 0} and runs.value == 1


def test_snapshots_are_versioned(spark, tmp_path):
    t = str(tmp_path / "issuers")
    assert versions(spark, t) == []
    assert write_snapshot(spark.range(3), t) == 1
    assert write_snapshot(spark.range(5), t) == 2
    assert read_latest(spark, t).count() == 5


def test_stream_ingest_replay_appends_nothing(spark, tmp_path):
    fx = Fixtures(spark, SF001)
    root = str(tmp_path)
    stored = (fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
              .withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS))
    stored.write.parquet(f"{root}/filings")
    _submissions(fx).repartition(3, "page").write.parquet(f"{root}/landing")
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/ck1", fx["fx_issuers"])
    after_first = spark.read.parquet(f"{root}/filings").count()
    assert after_first > stored.count()
    # same checkpoint: nothing left to read; fresh checkpoint: every file again, nothing new
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/ck1", fx["fx_issuers"])
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/ck2", fx["fx_issuers"])
    t = spark.read.parquet(f"{root}/filings")
    assert t.count() == after_first
    assert t.groupBy("issuer_id", "accession_no", "form_type").count().where("count > 1").count() == 0


def test_report_csv_as_python_reads_it(spark, tmp_path):
    import csv
    import glob

    from floatline.sinks.csv import write_report
    values = [15276527.0, 34.0, 0.1, 1e16, 1.5e-7, -2.5e9, 123456789.125, 0.0, 1e15, 0.0001, None]
    names = ['A "quoted" name', "comma, name", "  spaced ", "two\nlines", None, "x", "y", "z", "ü", "-", "'"]
    df = spark.createDataFrame([(i, n, v, i % 2 == 0) for i, (n, v) in enumerate(zip(names, values))], "i int, n string, v double, b boolean")
    write_report(df.orderBy("i"), str(tmp_path / "r.csv"))
    rows = []
    for part in sorted(glob.glob(str(tmp_path / "r.csv" / "part-*"))):
        with open(part, newline="") as f:
            head, *body = csv.reader(f)
        assert head == ["i", "n", "v", "b"]
        rows += body
    assert rows == [[str(i), n or "", "" if v is None else repr(v), str(i % 2 == 0)] for i, (n, v) in enumerate(zip(names, values))]


@pytest.mark.parametrize("near_by", [256, 1])
def test_a_batch_reads_state_not_the_table(spark, tmp_path, monkeypatch, near_by):
    """With the stored rows gone from the table, the same checkpoint still
    knows them: a batch looks at its own files and the state only."""
    import json
    monkeypatch.setattr(ingest, "NEAR_BY", near_by)
    root = str(tmp_path)

    def land(name, *docs):
        rows = [("%010d" % cik, page, json.dumps({"cik": str(cik), "filings": {"recent": {
            "accessionNumber": [f[0] for f in filings], "form": [f[1] for f in filings],
            "filingDate": [f[2] for f in filings], "primaryDocument": ["d.htm"] * len(filings)}}})[:None if filings else 9])
                for cik, page, filings in docs]
        spark.createDataFrame(rows, "cik10 string, page long, json string").coalesce(1).write.parquet(f"{root}/{name}")
        for part in glob.glob(f"{root}/{name}/part-*"):
            os.makedirs(f"{root}/landing", exist_ok=True)
            os.rename(part, f"{root}/landing/{name}.parquet")

    def run():
        ingest_filings(spark, f"{root}/landing", f"{root}/{table}", f"{root}/ck", issuers,
                       transitions_dir=f"{root}/transitions", failures_dir=f"{root}/failures")
        return {tuple(r) for r in spark.read.parquet(f"{root}/{table}").select("id", "issuer_id", "accession_no", "form_type").collect()}

    issuers = spark.createDataFrame([(1, "1", "priced"), (2, "2", None), (3, "x", None)], "id long, cik string, status string")
    layout = "id long, issuer_id long, accession_no string, form_type string, filing_date date, primary_doc_url string, " \
             "filing_index_url string, is_parsed boolean"
    table = "filings"
    spark.createDataFrame([(7, 1, "a", "S-1", None, None, None, False)], layout).write.parquet(f"{root}/filings")
    land("one", (1, 0, [("a", "S-1", "2001-01-01"), ("b", "S-1", "2001-01-02"), ("b", "S-1", "2001-01-03"), ("", "S-1", "")]),
         (2, 0, []), (9, 0, [("z", "S-1", "2001-01-01")]))
    assert run() == {(7, 1, "a", "S-1"), (8, 1, "b", "S-1")}
    assert [str(r[0]) for r in spark.read.parquet(f"{root}/filings").where("id = 8").select("filing_date").collect()] == ["2001-01-03"]
    table = "emptied"
    spark.createDataFrame([], layout).write.parquet(f"{root}/emptied")
    land("two", (1, 1, [("a", "S-1", "2001-01-01"), ("b", "S-1", "2001-01-02"), ("c", "424B4", "2001-02-01")]))
    land("three", (1, 2, [("c", "424B4", "2001-02-01"), ("d", "RW", "2001-03-01")]), (2, 1, [("e", "10-K", "2001-01-01"), ("f", "F-1", None)]))
    assert run() == {(9, 1, "c", "424B4"), (10, 1, "d", "RW"), (11, 2, "f", "F-1")}
    log = spark.read.parquet(f"{root}/transitions").orderBy("batch", "issuer_id").select("issuer_id", "old_status", "new_status", "changed")
    assert [tuple(r) for r in log.collect()] == [(1, "priced", "priced", False), (1, "priced", "priced", False),
                                                 (1, "priced", "withdrawn", True), (2, None, "filed", True)]
    failed = {tuple(r) for r in spark.read.parquet(f"{root}/failures").select("issuer_id", "cik10", "reason").collect()}
    assert failed == {(2, "0000000002", "unreadable_document"), (None, "0000000009", "unknown_issuer")}


def test_a_batch_that_runs_again_appends_nothing_twice(spark, tmp_path):
    """The files of a batch whose commit was lost are read again."""
    fx = Fixtures(spark, SF001)
    root = str(tmp_path)
    stored = (fx["fx_filings"].where(F.col("filing_date") < F.lit(SYNC_STORED_BEFORE).cast("date"))
              .withColumn("filing_index_url", F.lit(None).cast("string")).select(*FL.FILING_COLS))
    stored.write.parquet(f"{root}/filings")
    _submissions(fx).coalesce(1).write.parquet(f"{root}/landing")
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/ck", fx["fx_issuers"])
    after = {tuple(r) for r in spark.read.parquet(f"{root}/filings").collect()}
    for commit in glob.glob(f"{root}/ck/commits/0") + glob.glob(f"{root}/ck/commits/.0.crc"):
        os.remove(commit)
    ingest_filings(spark, f"{root}/landing", f"{root}/filings", f"{root}/ck", fx["fx_issuers"])
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/filings").collect()]
    assert len(rows) == len(after) and set(rows) == after


def test_a_slot_of_issuers_is_asked_for_once():
    """State is fetched and stored once for all issuers of a slot, not for each."""
    import pandas as pd

    class Value:
        held, calls = None, 0

        def get(self):
            Value.calls += 1
            return self.held

        def update(self, value):
            Value.calls += 1
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, key, value):
            return None

    p = ingest._processor()
    p.init(Handle())
    p.handleInitialState((0,), pd.DataFrame({"cik10": ["1", "2", "3"], "issuer_id": [1, 2, 3], "status": ["priced", None, None],
                                             "keys": [["S-1 a"], None, None]}), None)
    Value.calls = 0
    rows = pd.DataFrame({"cik10": ["1", "1", "2", "4"], "page": [0, 0, 0, 0], "pos": [0, 1, 0, 0], "accession_no": ["a", "b", "c", "d"],
                         "form_type": ["S-1"] * 4, "filing_date": ["2001-01-01"] * 4, "primary_doc_url": [None] * 4,
                         "filing_index_url": [None] * 4, "unreadable": [False] * 4})
    out = pd.concat(list(p.handleInputRows((0,), iter([rows[:2], rows[2:]]), None)))
    assert Value.calls == 2
    got = [(r.kind, r.cik10, None if pd.isna(r.issuer_id) else r.issuer_id, r.accession_no, r.new_status) for r in out.itertuples()]
    assert got == [("filing", "1", 1, "b", None), ("status", "1", 1, None, "priced"), ("filing", "2", 2, "c", None),
                   ("status", "2", 2, None, "filed"), ("unknown_issuer", "4", None, None, None)]
