"""Operator 12: counts and base scores against a recount, a proper distribution, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from floatline.llm import maxent_scoring as mx

LAYOUT = "doc_id long, text string, held_out boolean, uid int, word string, n string"
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], LAYOUT)


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [None]


def plain(rows):
    count = Counter(w for _, text, held in rows if not held for w in plain_words(text))
    n, v = sum(count.values()), len(count)
    out = []
    for doc_id, text, held in rows:
        words = plain_words(text)
        out.append((doc_id, bool(held), len(words), sum(w in count for w in words), n,
                    sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


def compare(spark, rows):
    got = [tuple(r) for r in mx.score_texts(frame(spark, rows)).collect()]
    want = plain(rows)
    order = lambda r: (str(r[0]), r[1:5], round(r[5], 6))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] <= 1e-6
    return got


ROWS = [(1, "The the THE cat.", False), (2, None, False), (3, "", True), (4, " \t\x0b", False), (5, "Élan ÉLAN élan K", True),
        (6, "the cat sat on the mat", True), (None, "null id words", False), (7, "the the the cat.", None),
        (7, "the the the cat.", False), (8, "w" * 500 + " x " + "w" * 500, False), (9, "w" * 500, True), (10, "\x00 \x1c nul", True)]


@pytest.mark.parametrize("piece,known", [(1 << 20, mx.KNOWN), (7, 3)])
def test_base_scores(spark, monkeypatch, piece, known):
    monkeypatch.setattr(mx, "PIECE", piece)
    monkeypatch.setattr(mx, "HELD_WORDS", 3)
    most = mx.known_words
    monkeypatch.setattr(mx, "known_words", lambda counts: most(counts, known))
    compare(spark, ROWS)


def test_nothing_to_learn_from_and_empty_table(spark):
    rows = [(1, "a b", True), (2, None, True)]
    assert [r["score"] for r in mx.score_texts(frame(spark, rows)).collect()] == [0.0, 0.0]
    compare(spark, rows)
    assert mx.score_texts(frame(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉ \t\x0b\x1c z"), max_size=40), st.integers(1, 9))
def test_words_in_pieces(text, piece):
    old, mx.PIECE = mx.PIECE, piece
    try:
        got = [w.decode() for words in mx.words_of(text) for w in words]
    finally:
        mx.PIECE = old
    assert got == plain_words(text)[:-1]


@pytest.mark.parametrize("piece", [1, 2, 3, 100])
def test_words_of_utf8_cut_anywhere(monkeypatch, piece):
    monkeypatch.setattr(mx, "PIECE", piece)
    text = "ÉtÉ été\u2028x\x0bAB \x1c c€\U0001f600 "
    got = [w.decode() for words in mx.words_of(text.encode()) for w in words]
    assert got == ["ÉtÉ", "été\u2028x", "ab", "\x1c", "c€\U0001f600"]


def test_known_words_are_at_most_so_many(spark):
    counts = spark.createDataFrame([(b"", 1)] + [(b"w%03d" % i, 1 + i // 4) for i in range(400)], "word binary, n long")
    for most in (1, 2, 10, 57, 399, 401, 500):
        got = mx.known_words(counts, most)
        assert 1 <= len(got) <= most and got[0][0] == b""
        if len(got) > 1:  # whole count levels, the highest
            least = min(n for _, n in got[1:])
            assert {w for w, n in got[1:]} == {b"w%03d" % i for i in range(400) if 1 + i // 4 >= least}
    assert len(mx.known_words(counts, 401)) == 401


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in docs]
    seen = {}
    train = mx.train

    def kept(tokens, corpus):
        seen["model"], seen["corpus"] = train(tokens, corpus), corpus
        return seen["model"]

    mx.train = kept
    try:
        got = mx.score_texts(frame(spark, rows)).collect()
    finally:
        mx.train = train
    return rows, got, seen["model"], seen["corpus"]


def test_held_out_texts_are_likelier_than_by_the_base(learned):
    _, got, _, _ = learned
    held = [r for r in got if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    gain = sum(r["score"] - r["base_score"] for r in held) / tokens
    assert gain > 0.15 and sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_model_is_a_distribution(learned):
    """Over all words after a context: modelled words, the other counted ones, one unseen."""
    _, _, model, corpus = learned
    n = corpus.modelled()
    rest = (corpus.tokens - corpus.counts[:n].sum() + 0.5 * (corpus.distinct - n + 1)) / corpus.rest_total()
    assert rest == pytest.approx(1)
    for context in ([5, 9], [mx.START - 1, 40], [17, 17]):
        total = 0.0
        words = [*range(n), mx.START - 1]  # the last stands for its class as a whole
        ids = np.array([x for w in words for x in (*context, w)])
        found = mx.log_probabilities(model, ids, np.arange(0, len(ids), 3))[2::3]
        total = (10 ** found).sum()
        assert total == pytest.approx(1, abs=1e-3)


def test_batches_do_not_matter(learned, monkeypatch):
    _, _, model, _ = learned
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, mx.START, rng.integers(1, 40)) for _ in range(60)]
    starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
    whole = mx.log_probabilities(model, np.concatenate(texts), starts)
    alone = np.concatenate([mx.log_probabilities(model, t, np.array([0])) for t in texts])
    monkeypatch.setattr(mx, "BATCH", 7)
    few = mx.log_probabilities(model, np.concatenate(texts), starts)
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, few, atol=1e-5)


def test_features_see_no_other_text():
    ids = np.array([3, 4, 5, 6, 7])
    first = [h[2:] for h in mx.features(ids, np.array([0, 2]))]
    second = [h[1:] for h in mx.features(np.array([9, 5, 6, 7]), np.array([0, 1]))]
    assert all((a == b).all() for a, b in zip(first, second))


def test_summed_updates_of_rows():
    learn = mx.Updates(np.zeros((8, 2), np.float32))
    rows = np.array([3, 1, 3, 3], np.uint16)
    gradient = np.array([[1, 0], [0, 2], [1, 0], [1, 0]], np.float32)
    learn.apply(rows, gradient)
    assert learn.times.tolist() == [0, 1, 0, 3, 0, 0, 0, 0]
    assert np.allclose(learn.weights[3], [-mx.STEP, 0], atol=1e-5) and np.allclose(learn.weights[1], [0, -mx.STEP], atol=1e-5)


def test_gradients_of_a_row_are_summed_whatever_their_number():
    rng = np.random.default_rng(5)
    rows = rng.permutation(np.repeat(np.arange(24), np.arange(24))).astype(np.uint16)  # row k comes k times
    gradient = rng.normal(size=(len(rows), 3)).astype(np.float32)
    learn = mx.Updates(np.zeros((24, 3), np.float32))
    learn.apply(rows, gradient)
    g = np.array([gradient[rows == k].sum(axis=0) for k in range(24)])
    assert learn.times.tolist() == list(range(24))
    assert np.allclose(learn.weights, -mx.STEP * g / np.sqrt((g * g).sum(axis=1, keepdims=True) + 1e-6), atol=1e-5)


def test_softmax_in_parts(monkeypatch):
    monkeypatch.setattr(mx, "SOFT", 3)
    rng = np.random.default_rng(6)
    bias, weights = rng.normal(size=(5, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32)
    of, rows, choice = rng.integers(0, 5, 10), [rng.integers(0, 9, 10) for _ in range(3)], rng.integers(0, 4, 10)
    z = np.exp(bias[of] + sum(weights[r] for r in rows))
    want = z / z.sum(axis=1, keepdims=True)
    assert np.allclose(mx._softmax(bias, of, weights, rows), want, atol=1e-6)
    assert np.allclose(mx._chosen(bias, of, weights, rows, choice), want[np.arange(10), choice], atol=1e-6)


def test_classes_are_balanced_and_follow_profiles():
    rng = np.random.default_rng(1)
    n = mx.MODELLED
    profiles = np.zeros((n, mx.PROFILE))
    kind = rng.integers(0, 2, n)
    profiles[np.arange(n), kind * 30] = 50
    profiles[np.arange(n), rng.integers(0, mx.PROFILE, n)] += 5
    cls = mx.classes(profiles, n)
    size = np.bincount(cls, minlength=mx.CLASSES)
    assert size.max() <= mx.SLOTS and size[mx.CLASSES - 1] == 0
    pure = sum(max(np.bincount(kind[cls == k], minlength=2)) for k in range(mx.CLASSES - 1))
    assert pure > 0.95 * n
