"""Language identification (operator 4).

Multinomial naive Bayes over hashed character n-grams (orders 1 to 3 of the
lower-cased text).  Counts come from all training texts: every task sums its
own dense count matrix and emits it in slices, which a second stage adds up.
The log-probability matrix (languages x buckets; its size depends only on
those two numbers) is broadcast, and texts are scored a batch at a time as
sparse rows in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when there is nothing to learn from.  Ties go to the
language first in code-point order.  Rows are independent: repeated rows get
equal results, extra columns are ignored, an empty table gives an empty
result.  A text of any length is read whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import ship_package, staged, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SLICE = 1 << 11
PIECE = 1 << 20  # code points handled at once
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def ngram_buckets(points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For each order, the bucket of the n-gram at every position."""
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
            for j in range(n):
                h = (h ^ points[j:len(points) - n + 1 + j]) * _MULT[j]
                h ^= h >> np.uint32(15)
            yield (h >> np.uint32(16)).astype(np.intp), n


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(text: str) -> Iterator[str]:
    if len(text) <= PIECE:
        yield text
    else:
        over = max(ORDERS) - 1  # the n-grams across a cut are those of both sides' overlap
        for at in range(0, len(text), PIECE):
            yield text[max(0, at - over):at + PIECE]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held, size = [], 0
            for text in part["text"]:
                for piece in _pieces(text):
                    held.append(piece)
                    size += len(piece)
                    if size >= PIECE:
                        _add(total, held)
                        held, size = [], 0
            _add(total, held)
    for lang, total in counts.items():
        for at in range(0, BUCKETS, SLICE):
            yield pd.DataFrame({"lang": [lang], "slice": [at // SLICE], "counts": [total[at:at + SLICE].tobytes()]})


def _add(total: np.ndarray, texts: list[str]) -> None:
    if texts:
        for bucket, _ in ngram_buckets(_points("\n".join(texts))):
            total += np.bincount(bucket, minlength=BUCKETS)


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for pdf in batches:
        for lang, part, counts in zip(pdf["lang"], pdf["slice"], pdf["counts"]):
            key = (lang, part)
            sums[key] = sums.get(key, 0) + np.frombuffer(counts, np.int64)
    if sums:
        yield pd.DataFrame({"lang": [k[0] for k in sums], "slice": [k[1] for k in sums],
                            "counts": [v.tobytes() for v in sums.values()]})


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix) from all ``rows`` (text, lang)."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string"), "text")
    layout = "lang string, slice int, counts binary"
    parts = rows.mapInPandas(_count, layout)
    # Slices of all languages are spread over tasks; each task holds its slices only.
    sums = staged(parts.repartition(16, "lang", "slice").mapInPandas(_sum, layout), "ngram-counts").toPandas()
    langs = sorted(set(sums["lang"]), key=lambda x: [ord(c) for c in x])
    counts = np.zeros((len(langs), BUCKETS))
    for lang, part, c in zip(sums["lang"], sums["slice"], sums["counts"]):
        counts[langs.index(lang), part * SLICE:(part + 1) * SLICE] = np.frombuffer(c, np.int64)
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def classify(texts: pd.Series, names: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's number, its posterior, has a letter) of a batch."""
    total = np.zeros((len(texts), max(1, len(names))))
    letter = np.zeros(len(texts), bool)
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if text is None or not names or not _has_letter(text):
            continue
        letter[i] = True
        for piece in _pieces(text):
            held.append((i, piece))
            size += len(piece)
            if size >= PIECE // 4:
                _score(held, weight, total)
                held, size = [], 0
    _score(held, weight, total)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return total.argmax(axis=1), np.where(letter, odds.max(axis=1) / odds.sum(axis=1), 0.0), letter


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logp.T)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weight = model.value
        for pdf in batches:
            best, sure, letter = classify(pdf["text"], names, weight)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": sure,
                                "lang_pred": [names[b] if ok else "und" for b, ok in zip(best, letter)]})

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double, lang_pred string")


def _score(held: list[tuple[int, str]], weight: np.ndarray, total: np.ndarray) -> None:
    """Add each text's summed log-probabilities to its row of ``total``."""
    points = [_points(piece) for _, piece in held]
    if not points:
        return
    row = np.array([i for i, _ in held])
    size = np.array([len(p) for p in points])
    end = np.cumsum(size)
    whole = np.concatenate(points)
    for bucket, n in ngram_buckets(whole):
        # n-grams that reach over the end of their text count nowhere
        owner = np.repeat(np.arange(len(size)), size)[:len(bucket)]
        inside = np.arange(len(bucket)) + n <= end[owner]
        bucket, owner = bucket[inside], owner[inside]
        for k in range(weight.shape[1]):
            got = np.bincount(owner, weights=weight[bucket, k], minlength=len(size))
            np.add.at(total[:, k], row, got)


def _fold(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the
    rows with crc32(doc_id) mod 5 other than 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    langs, logp = train(docs.where(_fold(5) != 0))
    out = predict(docs, langs, logp)
    return out.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those rejected: no language found, or one that is less
    than half sure.  All columns stay; rows are judged where they are read."""
    ship_package(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    langs, logp = train(plain.where(_fold(5) != 0))
    model = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logp.T)))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        names, weight = model.value
        _, sure, letter = classify(texts, names, weight)
        return pd.Series(letter & (sure >= 0.5))

    return docs.where(accepted(F.col("text").cast("string")))
