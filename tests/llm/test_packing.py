"""Operator 6: tokens, cutting, gapless exact placement, quality against best fit."""

import bisect
import zlib

import numpy as np
import pytest

from floatline.llm import packing

LAYOUT = "doc_id long, text string, length long, uid string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 1) for d, t in rows], LAYOUT)


def best_fit_decreasing(sizes, length):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i < len(gaps):
            g = gaps.pop(i)
        else:
            g, n = length, n + 1
        bisect.insort(gaps, g - s)
    return n


def check_places(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["size"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


@pytest.mark.parametrize("kind", ["uniform", "small", "tiny", "equal", "mixed"])
def test_places_are_gapless_and_near_best_fit(spark, kind, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 300)
    rng = np.random.default_rng(1)
    sizes = {"uniform": rng.integers(1, 2049, 1500), "small": rng.integers(1, 700, 1500), "tiny": rng.integers(1, 30, 3000),
             "equal": np.full(1500, 683), "mixed": np.r_[rng.integers(1, 60, 900), rng.integers(900, 2049, 600)]}[kind]
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, size long")
    got = packing.best_fit(df).join(df, "id").collect()
    assert sorted(r["id"] for r in got) == list(range(len(sizes)))
    n = check_places(got, 2048)
    assert n <= 1.03 * best_fit_decreasing(sizes.tolist(), 2048) + 2


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def test_documents_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"wörd{k}" for k in rng.integers(0, 900, int(rng.integers(0, 900))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 9000), (503, " \n\n  \t" * 50), (504, "日本語 🙂 " * 700), (505, "don't I'LL 12345 <|x|>")]
    got = packing.pack_documents(frame(spark, rows)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
    assert parts.keys() == {d for d, _ in rows}
    for d, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(parts[d], key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == packing.cut(len(ids))
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    check_places([{**r.asDict(), "size": r["length"]} for r in got], 2048)


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>", " \n<|endoftext|>\t ", "<|endoftext|",
                                  "a" + " " * 1_000_000 + "b <|endoftext|> c", "x" + "\n\u00a0" * 150_000])
def test_added_token_and_long_white_space(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids + [0]


def test_added_token_in_documents(spark):
    r, = packing.pack_documents(frame(spark, [(1, "hello <|endoftext|> world")])).collect()
    ids = np.array([31373, 220, 50256, 995, 0], "<u4")
    assert (r["length"], r["ids_crc32"]) == (5, zlib.crc32(ids))


def test_sequences_hold_the_documents(spark):
    docs = frame(spark, [(i, "some words here " * (i * 37 % 400)) for i in range(60)])
    packed = packing.pack_documents(docs)
    rows = packed.collect()
    seq = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, spark.createDataFrame(rows, packed.schema)).collect()}
    for r in rows:
        ids = seq[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


def test_repeated_rows_and_empty_table(spark):
    got = packing.pack_documents(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "z")])).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_leftovers_meet_across_ranges():
    plan = packing._meet([(0, 3, 0), (1, 2, 1), (2, 0, 6)])
    pairs = [(q, top - j, p, first + j) for q, top, p, first, n in plan for j in range(n)]
    # range 2 takes the latest gaps first: what range 1 left, then range 0; one piece stays over
    assert pairs == [(0, 2, 1, 0), (1, 1, 2, 0), (1, 0, 2, 1), (0, 1, 2, 2), (0, 0, 2, 3)]
