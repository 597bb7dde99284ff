"""A hot key holding a third of the rows: results stay exact and the top-1
is reduced map-side (partial WindowGroupLimit below the exchange)."""

import pytest
from pyspark.sql import functions as F

from floatline.operators import filings as FL
from floatline.operators.ranking import assign_ids
from floatline.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot_filings(spark):
    f = Fixtures(spark, SF)["fx_filings"]
    # every third filing moves to issuer 1
    return f.withColumn("issuer_id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("issuer_id")))


def _py_best(rows):
    tiers = {f: i for i, forms in enumerate(FL.FORM_TIERS) for f in forms}
    best = {}
    for r in sorted(rows, key=lambda r: r.id):
        if r.form_type not in tiers:
            continue
        k = (tiers[r.form_type], -(r.filing_date.toordinal() if r.filing_date else -10**9), r.id)
        if r.issuer_id not in best or k < best[r.issuer_id][0]:
            best[r.issuer_id] = (k, r.id)
    return {i: v[1] for i, v in best.items()}


def test_best_filing_exact_under_skew(spark, hot_filings):
    rows = hot_filings.select("id", "issuer_id", "form_type", "filing_date").collect()
    assert sum(r.issuer_id == 1 for r in rows) >= len(rows) // 3
    got = {r.issuer_id: r.id for r in FL.best_filing(hot_filings).collect()}
    assert got == _py_best(rows)


def test_top1_is_reduced_before_the_shuffle(spark, hot_filings):
    plan = spark._jvm.PythonSQLUtils.explainString(
        FL.best_filing(hot_filings)._jdf.queryExecution(), "formatted")
    tree = plan.split("\n\n")[0]
    partial = tree.index("WindowGroupLimit", tree.index("Exchange"))
    assert partial > tree.index("Exchange")  # a WindowGroupLimit sits under the exchange (map side)


def test_ids_contiguous_under_skew(spark, hot_filings):
    out = assign_ids(hot_filings.select("id", "issuer_id").withColumnRenamed("id", "fid"),
                     [F.col("issuer_id"), F.col("fid")], 100)
    rows = out.collect()
    ids = sorted(r.id for r in rows)
    assert ids == list(range(101, 101 + len(rows)))
    by_order = [r.id for r in sorted(rows, key=lambda r: (r.issuer_id, r.fid))]
    assert by_order == ids


def test_status_exact_under_skew(spark, hot_filings):
    issuers = Fixtures(spark, SF)["fx_issuers"]
    found = hot_filings.select("issuer_id", "accession_no", "form_type")
    got = {r.issuer_id: r.new_status for r in FL.derive_status(found, issuers).collect()}
    forms = {}
    for r in found.collect():
        forms.setdefault(r.issuer_id, set()).add(r.form_type)
    status = {r.id: r.status for r in issuers.collect()}
    for i, fs in forms.items():
        if i not in status:
            continue
        cur = status[i] or "candidate"
        want = ("withdrawn" if "RW" in fs else cur if cur in ("priced", "trading")
                else "filed" if fs & set(FL.FILING_FORMS) and cur != "withdrawn" else cur)
        assert got[i] == want, i


def test_worklist_never_reads_pages(spark, tmp_path):
    """With stored documents, the worklist scan reads (url, n_chars) only."""
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "documents")
    fx["raw_documents"].write.parquet(path)
    docs = spark.read.parquet(path)
    w = FL.parse_worklist(fx["fx_issuers"], fx["fx_filings"], docs)
    plan = spark._jvm.PythonSQLUtils.explainString(w._jdf.queryExecution(), "formatted")
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "n_chars" in line]
    assert schemas == ["ReadSchema: struct<url:string,n_chars:bigint>"]
    assert w.where("outcome = 'parse'").count() > 0


def _exchanges(spark, df):
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning")], plan


def test_pages_are_converted_where_they_are_read(spark, tmp_path):
    """The worklist is broadcast into the document scan; no page is exchanged."""
    from floatline.plans import jobs as J
    from floatline.session import materialize
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "documents")
    fx["raw_documents"].write.parquet(path)
    docs = spark.read.parquet(path)
    work = materialize(FL.parse_worklist(fx["fx_issuers"], fx["fx_filings"], docs))
    work = spark.createDataFrame(work.collect(), work.schema)  # of known, small size, as a stored table would be
    texts = J.parse_texts(work, docs)
    exchanges, plan = _exchanges(spark, texts)
    assert "BroadcastHashJoin" in plan and not exchanges
    assert texts.count() > 0


def test_text_functions_do_not_move_texts(spark, tmp_path):
    """On a table of enough files, and for the fixture texts: no exchange of a text column."""
    from floatline.functions.text import html_to_text
    from floatline.operators.partitioning import spread_small
    from floatline.plans.catalog import QUERIES
    path = str(tmp_path / "pages")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    pages = spread_small(spark.read.parquet(path), "page_id")
    assert not _exchanges(spark, pages.select(html_to_text("html").alias("t")))[0]
    for name in ("lockup_days", "offer_price", "lockup_section"):
        _, plan = _exchanges(spark, QUERIES[name](spark, "/root/testdata/sf0.001"))
        sent = plan.split(") Exchange")[1:]
        assert sent and not any("text" in part.split("\n")[1] for part in sent)


def test_regexes_run_only_for_what_is_asked(spark):
    """Statistics and worklists extract nothing; a table extracts its own fields."""
    from floatline.functions import extract as X
    from floatline.plans import jobs as J
    from floatline.plans.catalog import _offering_job
    calls = []
    orig = X.with_offering_fields
    X.with_offering_fields = lambda df, fields=None: calls.append(fields) or orig(df, fields=fields)
    try:
        res = _offering_job(spark, "/root/testdata/sf0.001")
        res.stats.collect(), res.tables["worklist"].count(), res.tables["filings"].count()
        assert calls == []
        res.tables["capitalization"]
        assert calls == [J.CAP_FIELDS] and "bookrunners" not in J.CAP_FIELDS and "offer_price" not in J.CAP_FIELDS
    finally:
        X.with_offering_fields = orig


def test_every_constraint_is_broken_by_some_row(spark):
    from floatline.plans.catalog import QUERIES
    found = {(r["table_name"], r["check_name"]) for r in
             QUERIES["constraint_violations"](spark, "/root/testdata/sf0.001").select("table_name", "check_name").distinct().collect()}
    children = {(t, c) for t in ("offerings", "capitalization", "lockups") for c in ("primary_key", "fk_issuer", "fk_filing", "not_null_issuer_id")}
    assert found == children | {("lockups", "enum_confidence")} | {
        ("issuers", c) for c in ("primary_key", "unique_cik", "not_null_company_name", "enum_status")} | {
        ("filings", c) for c in ("primary_key", "unique_filing", "fk_issuer", "not_null_issuer_id", "not_null_accession_no",
                                 "not_null_form_type", "not_null_filing_date", "enum_form_type")}
