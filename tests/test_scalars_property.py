"""F1, F10 against their Python definitions on generated inputs; F7 leaves
no markup in any page."""

import random
import re

from pyspark.sql import functions as F

from floatline.functions import scalars as S
from floatline.functions.text import html_to_text
from tests.conftest import SF001, one_column


def py_parse_number(raw):
    if not raw:
        return None
    raw = raw.strip()
    mult = 1.0
    low = raw.lower()
    if "billion" in low:
        mult, raw = 1e9, re.sub(r"\s*billion", "", raw, flags=re.IGNORECASE)
    elif "million" in low:
        mult, raw = 1e6, re.sub(r"\s*million", "", raw, flags=re.IGNORECASE)
    try:
        return float(raw.replace(",", "").strip()) * mult
    except ValueError:
        return None


def py_normalize_cik(raw):
    try:
        return str(int(raw)).zfill(10)
    except (TypeError, ValueError):
        return None


def _strings(alphabet, n=400, seed=3, max_len=14):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len)))) for _ in range(n)]


def test_parse_number_equals_python(spark):
    words = ["1", "2", "05", ",", ".", " ", "34", "000", "million", "Billion", "MILLION", "x", "\t"]
    rnd = random.Random(5)
    raws = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(400)]
    assert one_column(spark, raws, S.parse_number) == [py_parse_number(r) for r in raws]


def test_normalize_cik_equals_python(spark):
    raws = _strings("0123456789 -a", max_len=13)
    assert one_column(spark, raws, S.normalize_cik) == [py_normalize_cik(r) for r in raws]


def test_html_to_text_leaves_no_markup(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    out = pages.select(html_to_text("html").alias("t"))
    assert out.where(F.col("t").rlike("<[A-Za-z/!]")).count() == 0
    assert out.where(F.col("t").rlike("&(amp|quot|copy|middot|lt|gt|nbsp);")).count() == 0
    assert out.where(F.length("t") == 0).count() == 0
