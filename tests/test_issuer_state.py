"""Merged per-issuer state against the full recompute, and what a merge touches."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from floatline.operators import filings as FL
from floatline.operators import issuer_state as ST
from floatline.plans import reports as R
from floatline.sources.fixtures import Fixtures

FILINGS = "id long, issuer_id long, accession_no string, form_type string, filing_date date, primary_doc_url string"
OFFERINGS = "id long, issuer_id long, parsed_at date, offer_price double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    date = lambda: rng.choice([None, *[dt.date(2001, 1, d) for d in range(1, 7)], dt.date(1960, 1, 1)])
    forms = [*FL.TARGET_FORMS, "10-K", "", None]
    # issuer 1 holds a third of the rows
    who = lambda: 1 if rng.random() < 0.33 else rng.randint(2, 40)
    filings = [(i, who(), rng.choice(["a", "", None, "b"]), rng.choice(forms), date(), f"u{i}") for i in range(400)] + [(500, None, "a", "RW", None, None)]
    offerings = [(i, who(), date(), rng.choice([None, 1.5, 2.5])) for i in range(200)]
    return spark.createDataFrame(filings, FILINGS), spark.createDataFrame(offerings, OFFERINGS)


COLS = ["id", "offer_price"]


def _rows(states):
    return sorted(map(str, states.select("issuer_id", "rw", "filed", "best", "latest_filing", "latest_offering").collect()))


def test_merging_equals_recompute(spark, tables, tmp_path):
    f, o = tables
    states = ST.IssuerStates(spark, str(tmp_path / "s"), ST.day_states(f, o, COLS).schema, buckets=8)
    part = lambda df, k: df.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k)
    states.create(ST.day_states(part(f, 0), part(o, 0), COLS))
    for k in (1, 2, 3, 2):  # a day merged again changes nothing
        states.merge(ST.day_states(part(f, k), part(o, k), COLS))
    whole = ST.day_states(f, o, COLS)
    assert _rows(states.read()) == _rows(whole)
    best = {r["issuer_id"]: r["id"] for r in FL.best_filing(f.where("issuer_id IS NOT NULL")).collect()}
    late = {r["issuer_id"]: r["id"] for r in R.latest_per_issuer(o).collect()}
    got = states.read().select("issuer_id", "best.v.id", F.col("latest_offering.v.id").alias("o")).collect()
    assert {r["issuer_id"]: r["id"] for r in got if r["id"] is not None} == best
    assert {r["issuer_id"]: r["o"] for r in got if r["o"] is not None} == late


def test_status_equals_derive_status(spark, tables):
    f, o = tables
    issuers = spark.createDataFrame([(i, [None, "", "priced", "filed", "withdrawn", "candidate"][i % 6]) for i in range(1, 45)], "id long, status string")
    got = ST.state_status(ST.day_states(f, o, COLS), issuers.join(f.select(F.col("issuer_id").alias("id")).distinct(), "id"))
    want = FL.derive_status(f, issuers)
    filed = want.select("issuer_id")
    assert sorted(map(str, got.join(filed, "issuer_id", "left_semi").collect())) == sorted(map(str, want.collect()))


def test_one_filing_touches_one_bucket(spark, tmp_path):
    f = Fixtures(spark, "/root/testdata/sf0.001")["fx_filings"]
    o = spark.createDataFrame([], OFFERINGS)
    states = ST.IssuerStates(spark, str(tmp_path / "s"), ST.day_states(f, o, COLS).schema, buckets=16)
    states.create(ST.day_states(f.where("id <> 7"), o, COLS))
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(str(tmp_path / "s/*/*.parquet"))}
    before = files()
    new = states.merge(ST.day_states(f.where("id = 7"), o, COLS))
    assert new.count() == f.where("id = 7").count() == 1
    changed = set(before.items()) ^ set(files().items())
    assert len({os.path.dirname(p) for p, _ in changed}) == 1
    assert _rows(states.read()) == _rows(ST.day_states(f, o, COLS))
    assert _rows(states.of(f.where("id = 7"))) == _rows(new)


def test_empty_day_and_new_issuer(spark, tables, tmp_path):
    f, o = tables
    states = ST.IssuerStates(spark, str(tmp_path / "s"), ST.day_states(f, o, COLS).schema, buckets=4)
    states.create(ST.day_states(f.where("false"), o.where("false"), COLS))
    assert states.read().count() == 0
    assert states.merge(ST.day_states(f.where("false"), o.where("false"), COLS)).count() == 0
    states.merge(ST.day_states(f.where("issuer_id = 1"), o.where("issuer_id = 2"), COLS))
    assert {r["issuer_id"] for r in states.read().collect()} == {1, 2}
