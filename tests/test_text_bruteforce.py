"""F6 and F8 over the whole `documents` texts, checked against direct Python
implementations of their definitions (brute force, row by row)."""

import re

from pyspark.sql import functions as F

from floatline.functions import patterns as P
from floatline.functions.text import find_section, normalize_whitespace
from floatline.plans.catalog import FIND_SECTION_TITLES
from tests.conftest import SF001

BOUNDARY = re.compile(P.SECTION_BOUNDARY, re.MULTILINE)


def py_find_section(text, titles, window=P.SECTION_WINDOW_CHARS):
    for title in titles:
        m = re.search(re.escape(title), text, re.IGNORECASE)
        if m is None:
            continue
        lines = text[m.start():m.start() + window].splitlines()
        out = []
        for i, line in enumerate(lines):
            out.append(line)
            if i >= P.SECTION_BOUNDARY_FROM_LINE and BOUNDARY.match(line.strip()):
                break
        return "\n".join(out).strip()
    return None


def test_normalize_whitespace_equals_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.select("doc_id", "text", normalize_whitespace("text").alias("n")).collect()
    assert len(rows) > 0
    for r in rows:
        assert r.n == re.sub(r"\s+", " ", r.text).strip(), r.doc_id


def test_find_section_equals_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.select("doc_id", "text", find_section(F.col("text"), FIND_SECTION_TITLES).alias("s")).collect()
    hits = 0
    for r in rows:
        want = py_find_section(r.text, FIND_SECTION_TITLES)
        assert r.s == want, r.doc_id
        hits += want is not None
    assert hits > 0
