"""Declared schemas: the fixtures have their types, conform keeps other columns."""

import pytest
from pyspark.sql import functions as F

from floatline import schemas
from floatline.plans import jobs as J
from floatline.sources.fixtures import Fixtures
from tests.conftest import SF001


@pytest.mark.parametrize("name", list(schemas.TABLES))
def test_fixture_columns_have_declared_types(spark, name):
    declared = {f.name: f.dataType for f in schemas.TABLES[name].fields}
    for f in Fixtures(spark, SF001)["fx_" + name].schema.fields:
        assert declared[f.name] == f.dataType, f.name


def test_conform(spark):
    df = spark.createDataFrame([("7", "x", 1)], "id string, remark string, is_parsed int")
    out = schemas.conform(df, schemas.FILINGS)
    assert out.columns == schemas.FILINGS.names + ["remark"]
    assert [f.dataType for f in out.schema.fields][:9] == [f.dataType for f in schemas.FILINGS.fields]
    row = out.first()
    assert (row.id, row.remark, row.is_parsed, row.form_type) == (7, "x", True, None)


def test_sync_keeps_extra_filing_columns(spark):
    from floatline.plans.catalog import _submissions
    fx = Fixtures(spark, SF001)
    stored = schemas.conform(fx["fx_filings"].where("filing_date < '1996-01-01'").withColumn("remark", F.lit("old")), schemas.FILINGS)
    out = J.sync_sec_filings(fx["fx_issuers"], stored, _submissions(fx)).tables["filings"]
    assert out.columns == stored.columns
    assert out.where("remark = 'old'").count() == stored.count() < out.count()
