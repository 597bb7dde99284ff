"""D10 against a brute force over the ladder: every pair of forms in both
orders of input and of date, equal and missing dates, and random issuers."""

import datetime as dt
import itertools
import random

import pytest

from floatline.operators.filings import FORM_TIERS, best_filing

LADDER = {form: tier for tier, forms in enumerate(FORM_TIERS) for form in forms}
FORMS = [*LADDER, "RW", "EFFECT"]
EARLY, LATE = dt.date(1997, 4, 3), dt.date(1999, 8, 27)


def better(a, b):
    """Whether filing ``a`` (id, form, date) goes before ``b``."""
    if LADDER[a[1]] != LADDER[b[1]]:
        return LADDER[a[1]] < LADDER[b[1]]
    if a[2] != b[2]:
        return b[2] is None or (a[2] is not None and a[2] > b[2])
    return a[0] < b[0]


def brute_force(filings):
    on_ladder = [f for f in filings if f[1] in LADDER]
    winners = [f for f in on_ladder if all(f is g or better(f, g) for g in on_ladder)]
    assert len(winners) == bool(on_ladder)
    return winners[0] if winners else None


def issuers():
    days = [(EARLY, LATE), (LATE, EARLY), (EARLY, EARLY), (None, EARLY), (EARLY, None), (None, None)]
    cases = [[(f, d), (g, e)] for f, g in itertools.product(FORMS, repeat=2) for d, e in days]
    rng = random.Random(5)
    pick = lambda: (rng.choice(FORMS), rng.choice([None, EARLY, LATE, dt.date(1998, 1, rng.randint(1, 28))]))
    return cases + [[]] + [[pick() for _ in range(rng.randint(1, 9))] for _ in range(200)]


@pytest.fixture(scope="module")
def found(spark):
    ids = itertools.count(1)
    cases = [[(next(ids), form, day) for form, day in case] for case in issuers()]
    rows = [(i, n, form, day) for n, case in enumerate(cases) for i, form, day in case]
    random.Random(6).shuffle(rows)  # the stored order is the ids', not the frame's
    df = spark.createDataFrame(rows, "id long, issuer_id long, form_type string, filing_date date")
    return cases, {r["issuer_id"]: (r["id"], r["form_type"], r["filing_date"]) for r in best_filing(df).collect()}


def test_every_issuer_has_the_brute_force_winner(found):
    cases, got = found
    assert {n: brute_force(case) for n, case in enumerate(cases) if brute_force(case)} == got


def test_issuers_without_a_ladder_form_have_none(found):
    cases, got = found
    bare = [n for n, case in enumerate(cases) if all(form not in LADDER for _, form, _ in case)]
    assert bare and not set(bare) & set(got)
