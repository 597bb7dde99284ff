"""Operator 2: held-out accuracy, the risk estimator, defined results."""

import zlib

import numpy as np
import pytest

from floatline.llm import toxicity

LAYOUT = "doc_id long, text string, lang string, positive string, member int"


def corpus(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"word{i}" for i in range(300)])
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(5, 200))))
        bad = rng.random() < 0.15
        if bad:
            w[int(rng.integers(len(w)))] = rng.choice(["nastyone", "NASTYtwo,", "(nastyish)"])
        rows.append((i, " ".join(w), "en", "x", 1))
        if rng.random() < 0.5:
            labels.append((i, 1, int(bad)))
        rows[-1] += (bad,)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    bad = {r[0]: r[5] for r in rows}
    extra = [(9001, None, "en", "x", 1), (9002, "", None, None, None), (None, rows[0][1], "en", "x", 1), (0, *rows[0][1:5])]
    docs = spark.createDataFrame([r[:5] for r in rows] + extra, LAYOUT)
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    yes = [r for r in held if bad[r["doc_id"]]]
    assert np.mean([r["predicted"] for r in yes]) > 0.9
    assert np.mean([r["predicted"] for r in held if not bad[r["doc_id"]]]) < 0.05
    zero = [r["score"] for r in got if r["doc_id"] == 0]
    assert len(zero) == 2 and zero[0] == zero[1]


def test_scores_do_not_use_held_out_labels(spark):
    rows, labels = corpus(400, 3)
    docs = spark.createDataFrame([r[:5] for r in rows], LAYOUT)
    flip = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    layout = "doc_id long, quality int, toxic int"
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(labels, layout)).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(flip, layout)).collect()}
    assert one == two


def test_non_negative_risk_beats_plain_negatives():
    """A third of the unlabelled are positive: with the prior they score high."""
    rng = np.random.default_rng(0)
    make = lambda pos: np.unique(np.r_[rng.choice(np.arange(10, 60), 8), [rng.integers(0, 5)] if pos else []]).astype(np.int64)
    buckets = [make(True) for _ in range(400)] + [make(i % 3 == 0) for i in range(900)]
    positive = np.r_[np.ones(400, bool), np.zeros(900, bool)]
    w = toxicity.fit(buckets, positive, 1 / 3, 0)
    score = np.array([1 / (1 + np.exp(-(w[b].sum() + w[-1]))) for b in buckets[400:]])
    hidden = np.arange(900) % 3 == 0
    assert score[hidden].min() > score[~hidden].max()
    assert np.median(score[hidden]) > 0.7 and np.median(score[~hidden]) < 0.3


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = list(toxicity.batch_features([text]))
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    parts = np.unique(np.concatenate([b for _, b in toxicity.batch_features([text])]))
    assert (parts == whole[0][1]).all()


@pytest.mark.parametrize("n_labels", [0, 1])
def test_nothing_to_learn(spark, n_labels):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1), (2, None, "en", "x", 1)], LAYOUT)
    lab = spark.createDataFrame([(1, 1, 0)] * n_labels, "doc_id long, quality int, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, lab).collect()] == [(0.0, 0)] * 2
    assert toxicity.toxicity(docs.where("false"), lab).count() == 0
