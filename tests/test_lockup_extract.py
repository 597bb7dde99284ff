"""One sentence for every rule, sections and their windows."""

import pytest
from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions.text import html_to_text, lockup_section
from floatline.sources.fixtures import RULE_SENTENCES as S

DAYS = [("days_0", 150), ("days_1", 160), ("days_2", 170), ("days_3", 185), ("days_4", 190), ("days_5", 195),
        ("note_1", 200), ("staged_3", None), ("far_days", 210)]
# Two votes for 45 beat one for 400; 12 is out of range and never counts.
OTHER_DAYS = [("Lock-up. Some wait for 400 days after listing, others for 45 days after it, staff for 45 days from hire.", 45),
              ("Lock-up. Nobody sells for 12 days after listing.", None), ("A page on the weather.", None), ("", None)]


def _fields(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return X.with_lockup_fields(df).orderBy("i").collect()


def test_lockup_days(spark):
    cases = [(S[n], d) for n, d in DAYS] + OTHER_DAYS
    assert [r["lockup_days"] for r in _fields(spark, [t for t, _ in cases])] == [d for _, d in cases]


def test_staged_unlock(spark):
    yes = [S[f"staged_{k}"] for k in range(10)]
    no = [S["days_0"], S["days_3"], "A page on the weather.", ""]
    assert [r["is_staged_unlock"] for r in _fields(spark, yes + no)] == [True] * 10 + [False] * 4


def test_unlock_notes(spark):
    long = "Lock-up. " + "They wait for 100 days after " + "the long and winding listing " * 6 + ". A 90-day restricted period of " + "many words " * 15 + "."
    got = [r["unlock_notes"] for r in _fields(spark, [S["days_0"], S["note_1"], S["note_2"], "A page on the weather.", long])]
    assert got[0] == "for a period of 150 days following closing."
    assert got[1] == "200-day lock-up period ends then."
    assert got[2] == "30% released at once."
    assert got[3] is None and got[4].startswith("for 100 days after") and len(got[4]) == 300


@pytest.mark.parametrize("days,staged,expected", [
    (180, False, "high"), (90, False, "high"), (180, True, "medium"), (270, False, "medium"),
    (None, False, "low"), (None, True, "low"), (360, False, "high")])
def test_confidence(spark, days, staged, expected):
    df = spark.createDataFrame([(days, staged)], "d int, s boolean")
    assert df.select(X.lockup_confidence(F.col("d"), F.col("s"))).first()[0] == expected


def test_section_window_and_fallback(spark):
    df = spark.createDataFrame([("Intro. LOCK-UP agreements: " + "y" * 7000,)], "text string")
    sec = df.select(lockup_section(F.col("text"))).first()[0]
    assert sec.startswith("LOCK-UP agreements") and len(sec) == 6000
    # a title is found, its section holds no count: the whole text is searched
    [r] = _fields(spark, ["for 120 days after listing nobody sells. " + "x " * 3100 + "Underwriting. Nothing."])
    assert r["lockup_days"] == 120


def test_one_sentence_votes_twice(spark):
    [r] = _fields(spark, ["Lock-up. A 333-day restricted period applies. They agree not to offer stock for 77 days after that."])
    assert r["lockup_days"] == 77


def test_inline_tags_split_tokens(spark):
    df = spark.createDataFrame([("<p>Lock-up. A <i>99</i>-day lock-up period.</p>",)], "html string")
    text = df.select(html_to_text("html").alias("text")).first().text
    assert text == "Lock-up. A\n99\n-day lock-up period."
    assert _fields(spark, [text])[0]["lockup_days"] is None
