"""The fixture texts exercise every extraction rule and every section title."""

import re

import pytest

from floatline.functions import patterns as P
from floatline.sources.fixtures import Fixtures

FIRST_WINS = ["OFFER_PRICE", "PRICE_RANGE", "SHARES_OFFERED_TOTAL", "SHARES_PRIMARY", "SHARES_SECONDARY", "GREENSHOE",
              "POST_IPO_TIER1", "POST_IPO_TIER2", "PRE_IPO", "FULLY_DILUTED"]
ANY = ["LOCKUP_DAYS", "STAGED_UNLOCK", "UNLOCK_NOTES"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in Fixtures(spark, "/root/testdata/sf0.001")["fx_texts"].select("text").distinct().collect()]


@pytest.mark.parametrize("name", FIRST_WINS)
def test_every_rule_decides_a_row(texts, name):
    rules = [re.compile(p, re.I) for p in getattr(P, name)]
    decided = {next((k for k, r in enumerate(rules) if r.search(t[:3000])), None) for t in texts}
    assert set(range(len(rules))) <= decided


@pytest.mark.parametrize("name", ANY)
def test_every_rule_matches_a_row_alone(texts, name):
    dotall = getattr(P, name + "_DOTALL", [False] * len(getattr(P, name)))
    rules = [re.compile(p, re.I | (re.S if d else 0)) for p, d in zip(getattr(P, name), dotall)]
    alone = set()
    for t in texts:
        hits = [k for k, r in enumerate(rules) if r.search(t[:3000])]
        if len(hits) == 1:
            alone.add(hits[0])
    assert alone >= set(range(len(rules))) - ({0} if name == "LOCKUP_DAYS" else set())


def test_every_title_opens_a_section(texts):
    low = [t.lower() for t in texts]
    opened = {next((k for k, title in enumerate(P.LOCKUP_SECTION_TITLES) if title in t), None) for t in low}
    assert set(range(len(P.LOCKUP_SECTION_TITLES))) <= opened


def test_large_filings(spark, texts):
    assert max(map(len, texts)) > 100_000
    docs = Fixtures(spark, "/root/testdata/sf0.001")["raw_documents"]
    assert docs.where("html like '%" + "<td></td>" * 5000 + "%'").count() > 0


def test_views_grow_with_their_source(spark):
    small, large = (Fixtures(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    for view, column in (("nasdaq_rows", "dealID"), ("fx_candidates", "company_name")):
        n = [f[view].select(column).distinct().count() for f in (small, large)]
        assert n[1] > 8 * n[0]
