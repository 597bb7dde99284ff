"""The literal gate: words every match holds, and equal results behind it."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions import patterns as P
from floatline.functions.literals import Gate, holds, required
from floatline.sources.fixtures import RULE_SENTENCES, Fixtures
from tests.conftest import SF001

ALL = [*P.OFFER_PRICE, *P.PRICE_RANGE, *P.SHARES_OFFERED_TOTAL, *P.SHARES_PRIMARY, *P.SHARES_SECONDARY, *P.GREENSHOE,
       *P.POST_IPO_TIER1, *P.POST_IPO_TIER2, *P.PRE_IPO, *P.FULLY_DILUTED, *P.LOCKUP_DAYS, *P.STAGED_UNLOCK, *P.UNLOCK_NOTES,
       P.BOOKRUNNER_BLOCK, P.BOOKRUNNER_FALLBACK]


def test_words_of_patterns():
    assert required(r"offering\s+price[^.]{0,9}\$(\d+)") == [("offering",), ("price",)]
    assert set(required(r"(?:alpha|beta)\s+gamma?")) == {("alpha", "beta"), ("gamm",)}
    assert required(r"(?:alpha)?\s*(?<!before)word{2}") == []          # "wor" is too short, the rest may be missing
    assert required(r"(?:alpha|\d+)\s+[abcd]+") == []                  # a branch without a word
    assert required(r"(?:long)+er") == [("long",)]


@pytest.mark.parametrize("pattern", ALL, ids=range(len(ALL)))
def test_every_match_holds_its_words(pattern):
    for text in RULE_SENTENCES.values():
        for t in (text, text.upper(), text.lower(), text.replace("s", "\u017f"), text.replace("k", "\u212a"),
                  text.replace("i", "\u0131"), text.replace("i", "\u0130")):
            if re.search(pattern, t, re.IGNORECASE | re.DOTALL):
                assert holds(pattern, t)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([p for p in ALL if "(?<!" not in p]).flatmap(
    lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.IGNORECASE)))))
def test_generated_matches_hold_their_words(found):
    pattern, text = found
    assert holds(pattern, text)


def test_gated_fields_equal_ungated_ones(spark):
    texts = Fixtures(spark, SF001)["fx_texts"].select("filing_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "No words here."), (-4, RULE_SENTENCES["offered_1"].replace("s", "\u017f")),
                                 (-5, RULE_SENTENCES["days_0"].upper()), (-6, RULE_SENTENCES["note_1"].replace("k", "\u212a"))],
                                "filing_id long, text string")
    texts = texts.unionByName(odd)
    t = F.col("text")
    low, high = X.price_range(t)
    plain = texts.select(
        "filing_id", X.offer_price(t).alias("offer_price"), low.alias("price_range_low"), high.alias("price_range_high"),
        X.shares_offered_total(t).alias("shares_offered_direct"), X.shares_primary(t).alias("shares_primary"),
        X.shares_secondary(t).alias("shares_secondary"), X.greenshoe_shares(t).alias("greenshoe_shares"),
        X.bookrunners(t).alias("bookrunners"), X.shares_post_ipo(t).alias("shares_outstanding_post_ipo"),
        X.shares_pre_ipo(t).alias("shares_outstanding_pre_ipo"), X.fully_diluted_shares(t).alias("fully_diluted_shares"))
    gated = X.with_offering_fields(texts).drop("text").select(*plain.columns)
    assert sorted(map(str, gated.collect())) == sorted(map(str, plain.collect()))
    from floatline.functions.text import lockup_section
    sec = lockup_section(t)
    plain = texts.select("filing_id", X.lockup_days(t).alias("lockup_days"), X.staged_unlock(sec).alias("is_staged_unlock"),
                         X.unlock_notes(sec).alias("unlock_notes"))
    gated = X.with_lockup_fields(texts).select(*plain.columns)
    assert sorted(map(str, gated.collect())) == sorted(map(str, plain.collect()))


def test_the_lower_case_copy_is_made_once(spark):
    """Not again for every word, inside the list of words."""
    gate = Gate("alpha beta", "gamma (?:delta|epsilon)")
    df = gate.add(spark.sql("SELECT 'Some ALPHA BETA' text UNION ALL VALUES ('gamma'), (null)"), "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    transforms = [line for line in plan.splitlines() if "transform(" in line]
    assert transforms and all("lower(" not in line for line in transforms)
    assert [r[1] is None for r in df.collect()] == [False, False, True]
