"""Operator 13: the hash, the bound on pairs, and whole results against a plain recount."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from floatline.llm import token_alignment as ta

LAYOUT = "doc_id long, text string, a binary, groups string, slice int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, b"x", "x", 1) for d, t in rows], LAYOUT)


def plain_tokens(text):
    """Ids and byte ends by the contract's own libraries, or nothing."""
    if not text:
        return [], [], [], []
    a_bytes, b_bytes = ta.entry_bytes()
    raw = (" " + text).encode()
    a = ta._byte_bpe_json(ta.A_NAME).encode(" " + text, add_special_tokens=False).ids
    b = ta._piece_bpe(ta.B_NAME).encode(text)
    if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
        return [], [], [], []
    ends = []
    for ids, entries in ((a, a_bytes), (b, b_bytes)):
        at, found = 0, []
        for i in ids:
            at += len(entries[i])
            found.append(at)
        ends.append(found)
    return a, b, ends[0], ends[1]


def plain(rows):
    links, notes = [], []
    for _, text in rows:
        a, b, end_a, end_b = plain_tokens(text)
        pairs, groups, i, j = [], [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            p, q = end_a.index(cut, i), end_b.index(cut, j)
            pairs.append((a[p], b[q]))
            groups.append(",".join(map(str, a[i:p + 1])) + "|" + ",".join(map(str, b[j:q + 1])))
            i, j = p + 1, q + 1
        links.append(pairs)
        notes.append((len(a), len(b), ";".join(groups)))
    count = Counter(p for pairs in links for p in pairs)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, _), pairs, (n_a, n_b, groups) in zip(rows, links, notes):
        out.append((doc_id, n_a, n_b, len(pairs), len(pairs), sum(count[p] == best[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), groups))
    return out, count


TEXTS = [None, "", " ", "Hello world", "Hello world", "  two  spaces\t\ttabs\nlines\r\n", "naïve café ▁ under", "日本語のテキスト 🙂🙂 emoji",
         "<|endoftext|> <s> </s> <unk> <0x41> [INST]", "été Übergrößenträger ﬁ ligature ½ ²", "a" * 400, " leading", "trailing ",
         "\x00nul\x07", "x1y2z3 12345678 3.14159", "the the the of of", "​zero width", "٣٤٥ عربى"]


def test_whole_results(spark, monkeypatch):
    monkeypatch.setattr(ta, "CHUNK", 60)
    monkeypatch.setattr(ta, "SLICE", 1000)
    rows = list(enumerate(TEXTS)) + [(None, "Hello world"), (3, "the the")]
    got = [tuple(r) for r in ta.aligned(frame(spark, rows)).collect()]
    want, count = plain(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    table = {(r["a"], r["b"]): r["count"] for r in ta.pair_table(frame(spark, rows)).collect()}
    assert table == dict(count)
    hashed = {(r[0], r[-1]) for r in ta.aligned(frame(spark, rows), digest=True).collect()}
    assert hashed == {(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want}


def test_empty_table(spark):
    assert ta.aligned(frame(spark, [])).collect() == []


def test_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in ta.aligned(docs).collect()]
    assert sorted(got) == sorted(plain(rows)[0])


def test_long_runs_and_long_texts(spark):
    rows = [(1, "x" + " " * 300_000 + "y"), (2, "word " * 200_000)]
    got = {r["doc_id"]: r for r in ta.aligned(frame(spark, rows)).collect()}
    for doc_id, text in rows:
        a, b, end_a, end_b = plain_tokens(text)
        assert (got[doc_id]["n_a"], got[doc_id]["n_b"], got[doc_id]["n_links"]) == (len(a), len(b), len(set(end_a) & set(end_b)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_fast_and_plain_ids_are_equal(text):
    a, b = ta.encode([text])[0]
    want = plain_tokens(text)
    assert np.frombuffer(a, ta.IDS).tolist() == want[0] and np.frombuffer(b, ta.IDS).tolist() == want[1]


def test_possible_pairs_are_bounded_and_hold_every_link():
    a_bytes, b_bytes = ta.entry_bytes()
    keys = ta.possible_pairs(a_bytes, b_bytes)
    assert len(keys) == 324_297
    some = np.random.default_rng(0).choice(keys, 2000)
    for key in some:
        x, y = a_bytes[key // len(b_bytes)], b_bytes[key % len(b_bytes)]
        assert x and y and (x.endswith(y) or y.endswith(x))


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**60), max_size=300), st.sets(st.integers(0, 2**60), max_size=50))
def test_perfect_hash(keys, others):
    index = ta.PerfectHash(np.array(sorted(keys), np.int64))
    assert sorted(index.look_up(np.array(sorted(keys), np.int64))) == list(range(len(keys)))
    strangers = np.array(sorted(others - keys), np.int64)
    assert (index.look_up(strangers) == -1).all()


@pytest.mark.parametrize("n", [1, 64, 100_000])
def test_perfect_hash_is_small(n):
    index = ta.PerfectHash(np.arange(n) * 7)
    bits = sum(64 * len(words) for words, _ in index.levels)
    assert bits <= 4.5 * n + 64 * 30
