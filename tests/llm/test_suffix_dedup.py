"""Operator 3 against a brute-force search of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floatline.llm import suffix_dedup
from floatline.llm.common import maybe_in

LAYOUT = "doc_id long, text string, key string, g int"


def brute(texts, n=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i:i + n]] > 1:
                cover[i:i + n] = True
        edge = np.diff(np.r_[0, cover.astype(int)])
        kept = np.frombuffer(r, np.uint8)[~cover].tobytes() if r else b""
        out.append((len(r), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], LAYOUT)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                 for r in suffix_dedup.remove_repeats(df).collect())
    want = sorted((d if d is not None else -1, *w) for (d, _), w in zip(rows, brute([t for _, t in rows])))
    assert got == want


def cases():
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    a, b = text(1500), text(700)
    line = text(395)
    rows = [(1, a), (2, text(300) + a[200:900] + text(100)), (3, b), (4, b), (4, b), (5, None), (6, ""), (7, "x" * 3000),
            (8, "que " * 400), (9, "que " * 99), (10, text(399)), (11, line[:390] + "1"), (None, text(100) + b[:420]),
            (12, text(50) + a[200:599]), (13, text(50) + a[200:601].strip() + "é")]
    rows += [(100 + i, text(150) + line + text(150)) for i in range(40)]                 # 395 bytes and more in common
    rows += [(200 + i, text(100) + line + "0123456789"[:3 + i % 8] + text(30)) for i in range(30)]
    doc = list(text(1200))
    for i in range(25):                                                                   # near copies
        d = list(doc)
        d[int(rng.integers(1200))] = "#"
        rows.append((300 + i, "".join(d)))
    return rows


def test_equals_brute_force(spark):
    check(spark, cases())


@pytest.mark.parametrize("segment", [700, 1 << 23])
def test_long_text_in_segments(spark, monkeypatch, segment):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcd "), 9000))
    texts = [long[:5000] + long[1000:2500] + long[5000:], long]
    off = np.array([0, len(texts[0].encode())])
    data = np.frombuffer(texts[0].encode(), np.uint8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    doc, p, lo, hi, h = suffix_dedup.runs(data, off)
    windows = np.concatenate([np.arange(a - y, a - x + 1) for a, x, y in zip(p, lo, hi)])
    assert sorted(windows) == list(range(len(data) - 399))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, rows)


def test_kept_bytes_round_trip(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in cases()], LAYOUT)
    for r in suffix_dedup.remove_repeats(df, with_bytes=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], LAYOUT)).count() == 0


def test_bitmap_filter_loses_nothing(spark):
    wanted = spark.range(0, 50000, 7).select(F.col("id").alias("k"))
    got = maybe_in(spark.range(0, 50000).select(F.col("id").alias("k"), F.lit(1).alias("x")), "k", wanted)
    assert got.join(wanted, "k").count() == wanted.count()
    assert got.count() < 1.01 * wanted.count()
    assert maybe_in(spark.range(10).withColumnRenamed("id", "k"), "k", wanted.where("false")).count() == 0
