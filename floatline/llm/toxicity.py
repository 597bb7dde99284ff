"""Toxicity scores by non-negative positive-unlabelled learning (operator 2).

Only confirmed toxic examples are used as labels; everything else is
unlabelled text.  With class prior pi the risk of a classifier g is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

(l: logistic loss): unlabelled texts count as negatives, corrected for the
toxic ones among them, and the correction may not drive the risk below zero.
Where it would, the step goes the other way, as the method prescribes.  Each
member of a small ensemble is a linear model over hashed features of the
whole text (distinct words, and their first four and five letters), trained
in numpy inside a Spark task; the members' logits are averaged and broadcast
(``BUCKETS`` numbers) to score every document where it is read.

Bounded samples, chosen by a hash of the text: up to about ``MAX_POSITIVE``
confirmed toxic and ``MAX_UNLABELLED`` unlabelled training documents.  The
prior is the share of toxic among all labelled training rows.

Labels come only from rows with crc32(doc_id as text) mod 4 other than 2, and
so does the unlabelled sample.  Defined results: null and empty texts are
scored like a text without words.  With no confirmed toxic example every score
is 0.  A doc_id with several labels is toxic if one says so.  Repeated rows get
equal scores, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import staged, table
from floatline.llm.vectext import _powers, slice_hash

BITS = 18
BUCKETS = 1 << BITS
PREFIXES = (4, 5)
MAX_POSITIVE = 3000
MAX_UNLABELLED = 12000
MEMBERS = 3
MIN_RATIO = 3.0  # root of the likelihood ratio that a feature must reach to be used
EPOCHS = 300
RATE = 0.05
PIECE = 1 << 20
U = np.uint64
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalnum() for c in range(1 << 16)]))
    return np.where(points < 1 << 16, _letters[0][np.minimum(points, 0xFFFF)], True)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct features of each text, sorted."""
    data = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(data), np.uint32)
    off = np.cumsum([0] + [len(d) // 4 for d in data])
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _is_letter(points)
    starts, ends = letter.copy(), letter.copy()
    starts[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    starts[off[:-1][off[:-1] < n]] = letter[off[:-1][off[:-1] < n]]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = letter[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93) * _powers(n, False), out=run[1:])
    doc = np.searchsorted(off, start, side="right") - 1
    keys = [(doc << BITS) | (slice_hash(run, start, end) >> U(64 - BITS)).astype(np.int64)]
    for k in PREFIXES:
        long = end - start >= k
        s = start[long]
        h = slice_hash(run, s, s + k) * U(2 * k + 1)
        keys.append((doc[long] << BITS) | (h >> U(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & (BUCKETS - 1)


def batch_features(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a whole batch, some texts at a time; a long text is read
    in pieces cut between words."""
    held, rows, size = [], [], 0

    def flush():
        doc, bucket = features(held)
        key = np.unique((np.array(rows, np.int64)[doc] << BITS) | bucket) if len(doc) else np.zeros(0, np.int64)
        return key >> BITS, key & (BUCKETS - 1)

    for i, text in enumerate(texts):
        text = text or ""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = text.rfind(" ", at, end)
                end = cut if cut > at else end
            held.append(text[at:end])
            rows.append(i)
            size += end - at
            at = end
        if size >= PIECE and held:
            yield flush()
            held, rows, size = [], [], 0
    if held:
        yield flush()


def screen(buckets: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features whose share of positive texts differs from their share of
    unlabelled ones by more than chance explains; the others are noise that a
    long text would add up."""
    count = lambda mask: np.bincount(np.concatenate([b for b, m in zip(buckets, mask) if m] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    n1, n0 = max(1, positive.sum()), max(1, (~positive).sum())
    in1, in0 = count(positive).astype(float), count(~positive).astype(float)
    # Signed root of the likelihood ratio: unlike a normal score it is sound for rare features.
    expect1, expect0 = (in1 + in0) * n1 / (n1 + n0), (in1 + in0) * n0 / (n1 + n0)
    term = lambda seen, expected: seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12))
    ratio = np.sqrt(np.maximum(0.0, 2 * (term(in1, expect1) + term(in0, expect0))))
    return np.flatnonzero(ratio >= MIN_RATIO)


def fit(buckets: list[np.ndarray], positive: np.ndarray, prior: float, seed: int,
        epochs: int = EPOCHS, l2: float = 1e-3) -> np.ndarray:
    """Weights (BUCKETS + 1, the last is the bias) that minimise the
    non-negative risk, by full-batch Adam."""
    used = screen(buckets, positive)
    slot = np.full(BUCKETS, -1)
    slot[used] = np.arange(len(used))
    col = [slot[b] for b in buckets]
    col = [c[c >= 0] for c in col]
    row = np.repeat(np.arange(len(col)), [len(c) for c in col])
    col = np.concatenate(col) if col else np.zeros(0, int)
    n, m = len(buckets), len(used)
    w = np.random.default_rng(seed).normal(0, 1e-3, m)
    bias = np.log(prior / (1 - prior))
    mom, vel = np.zeros(m + 1), np.zeros(m + 1)
    w_sum, bias_sum, kept = np.zeros(m), 0.0, 0
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    for step in range(1, epochs + 1):
        g = np.bincount(row, weights=w[col], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))       # l'(g) = p - 1, l'(-g) = p
        loss_neg = np.logaddexp(0, g)
        negative_risk = loss_neg[~positive].sum() / n_unl - prior * loss_neg[positive].sum() / n_pos
        d_neg = np.where(positive, -prior * p / n_pos, p / n_unl)
        if negative_risk >= 0:
            d = d_neg + np.where(positive, prior * (p - 1) / n_pos, 0.0)
        else:
            d = -d_neg
        grad = np.r_[np.bincount(col, weights=d[row], minlength=m) + l2 * w, d.sum()]
        mom = 0.9 * mom + 0.1 * grad
        vel = 0.999 * vel + 0.001 * grad ** 2
        move = RATE * (1 - step / (epochs + 1)) * (mom / (1 - 0.9 ** step)) / (np.sqrt(vel / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
        if 2 * step > epochs:  # the mean of the second half of all steps is steadier than the last
            w_sum += w
            bias_sum += bias
            kept += 1
    out = np.zeros(BUCKETS + 1)
    out[used] = w_sum / kept
    out[-1] = bias_sum / kept
    return out


def _encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sampled texts as feature lists, once for every member that uses them."""
    for pdf in parts:
        found = [np.zeros(0, np.int32)] * len(pdf)
        for doc, bucket in batch_features(pdf["text"]):
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(doc)]):
                found[doc[a]] = bucket[a:b].astype(np.int32)
        out = pdf[["positive", "member"]].assign(buckets=[f.tobytes() for f in found])
        yield out


def _train(prior: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["positive", "buckets"])  # the same sum in every run
        w = fit([np.frombuffer(b, np.int32) for b in pdf["buckets"]], pdf["positive"].to_numpy(bool), prior, int(key[0]))
        return pd.DataFrame({"member": [int(key[0])], "weights": [w.astype(np.float32).tobytes()]})
    return run


def _part(column, share: float):
    """Rows whose hash falls in a share of all values."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def train(docs: DataFrame, labels: DataFrame, members: int = MEMBERS) -> np.ndarray | None:
    """Averaged weights, or None without a confirmed toxic example."""
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = min(0.9, n_toxic / n_known)
    # at most about MAX_POSITIVE ids: the broadcast below is bounded by that
    ids = known.where("toxic = 1").where(_part(F.col("doc_id"), MAX_POSITIVE / n_toxic)).select(F.col("doc_id").alias("p_id"))
    pool = docs.where(usable)
    n_docs = docs.count()
    drawn = _part(F.col("text"), MAX_UNLABELLED / max(1, n_docs))
    third = F.pmod(F.xxhash64("text"), F.lit(members)).cast("int")
    sample = (pool.join(F.broadcast(ids), F.col("doc_id") == F.col("p_id"), "left")
              .select("text", F.col("p_id").isNotNull().alias("is_p"), F.coalesce(drawn, F.lit(False)).alias("is_u"))
              .where("is_p OR is_u")
              # positives go to every member, unlabelled texts to all but one
              .withColumn("use", F.concat(
                  F.when(F.col("is_p"), F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: F.struct(F.lit(True).alias("positive"), m.alias("member"))))
                  .otherwise(F.array().cast("array<struct<positive:boolean,member:int>>")),
                  F.when(F.col("is_u"), F.transform(F.filter(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: m != third),
                                                    lambda m: F.struct(F.lit(False).alias("positive"), m.alias("member"))))
                  .otherwise(F.array().cast("array<struct<positive:boolean,member:int>>"))))
              .select("text", F.explode("use").alias("use")).select("text", "use.positive", "use.member"))
    coded = staged(sample.mapInPandas(_encode, "positive boolean, member int, buckets binary"), "toxicity-sample")
    fitted = coded.groupBy("member").applyInPandas(_train(prior), "member int, weights binary").toPandas()
    if not len(fitted):
        return None
    return np.mean([np.frombuffer(w, np.float32) for w in fitted.sort_values("member")["weights"]], axis=0)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = train(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    if weights is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        model = docs.sparkSession.sparkContext.broadcast(weights)

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = model.value
            for pdf in parts:
                logit = np.full(len(pdf), float(w[-1]))
                for doc, bucket in batch_features(pdf["text"]):
                    logit += np.bincount(doc, weights=w[bucket], minlength=len(pdf))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))})

        scored = docs.mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
