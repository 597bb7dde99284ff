"""Operators 1, 4, 5 and 10 against brute force and planted cases."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from floatline.llm import exact_dedup, jaccard_join, language_id, mixing

SF = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, key string, root string, size int"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    full = [(d, t, lang, s, None if t is None else len(t), "k", "r", 1) for d, t, lang, s in rows]
    return spark.createDataFrame(full, LAYOUT)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(3)
    base = prose(rng, 120)
    changed = base.split()
    changed[60] = "other"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(changed), "de", None),
            (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "one two", "de", "b"),
            (8, "one two", None, "c"), (None, base + "\n", "en", "a"), (9, prose(rng, 5000), "en", "a"),
            (10, base.replace(" ", "  "), "fr", "a"), (11, "12 34 --", "fr", "a")]
    rows += [(20 + i, prose(rng, 80), "en", "a") for i in range(20)]
    return rows


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_rows(spark, awkward):
    got = exact_dedup.exact_dedup(frame(spark, awkward)).collect()
    assert len(got) == len(awkward)
    groups = {}
    for d, t, *_ in awkward:
        groups.setdefault(normalised(t), []).append((-len(t or ""), d is None, d or 0, d))
    for key, members in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        rows = [r for r in got if r["digest"] == digest]
        assert len(rows) == len(members) == rows[0]["group_size"]
        assert {r["keep_id"] for r in rows} == {min(members)[3]}
        assert sum(r["kept"] for r in rows) == 1


def test_exact_dedup_keeps_columns_and_one_row(spark, awkward):
    docs = frame(spark, awkward + [awkward[0]])
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    kept = [r["text"] for r in out.collect()]
    assert sorted(normalised(t) for t in kept) == sorted({normalised(t) for _, t, *_ in awkward})


def test_digest_index_is_persistent(spark, awkward):
    docs = frame(spark, awkward)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.ingest(exact_dedup.digests(docs.where("doc_id < 9")), 0).count()
    again = exact_dedup.DigestIndex(spark, index.path, 4)  # as a later session would open it
    fresh = again.ingest(exact_dedup.digests(docs), 1).collect()
    every = again.entries().collect()
    assert len(every) == len({e["digest"] for e in every}) == first + len(fresh) == len({normalised(t) for _, t, *_ in awkward})
    assert again.ingest(exact_dedup.digests(docs), 2).count() == 0


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.OP5_SQL}) order by 1").fetchall()
    got = exact_dedup.op5_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    link = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    return np.array(link)


def near_copies(rng, n, first):
    base = prose(rng, 300).split()
    out = []
    for i in range(n):
        w = list(base)
        w[int(rng.integers(300))] = f"new{i}"
        out.append((first + i, " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join_equals_brute_force(spark, awkward, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [r for r in awkward if r[0] is not None] + near_copies(rng, 60, 100)
    half = prose(rng, 100)
    rows += [(300, half + " " + prose(rng, 100), "en", "a"), (301, half + " " + prose(rng, 100), "en", "a")]
    link = brute_links(rows)
    got = {}
    for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], (r["class_id"], r["class_size"], r["n_links"]))
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i]] + [root[j] for j in np.flatnonzero(link[i])]) for i in range(len(rows))]
    for i, row in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        assert got[row[0]] == (min(members), len(members), int(link[i].sum())), row[0]


def test_jaccard_recall_at_threshold(spark):
    """Pairs just above 0.8: nearly all found, none below."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(100):
        w = prose(rng, 200).split()
        v = list(w)
        for at in (40, 90, 140, 170):  # 20 of 196 shingles change: J = 176 / 216 = 0.815
            v[at] = "changed"
        rows += [(2 * i, " ".join(w), "en", "a"), (2 * i + 1, " ".join(v), "en", "a")]
    got = jaccard_join.jaccard_classes(frame(spark, rows)).collect()
    assert sum(r["n_links"] for r in got) >= 0.97 * 200
    assert all(r["class_size"] <= 2 for r in got)


def test_jaccard_stage_keeps_one_of_each_class(spark, awkward):
    docs = frame(spark, awkward + [awkward[0]])
    out = jaccard_join.keep_class_representatives(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 10 not in ids
    assert {4, 5, 6, 7, 9, 11} <= set(ids) and 8 not in ids


def test_mix_targets_reshare():
    # a: weight 5, b: 2, c: 1, None: 5
    got = mixing.targets([("b", 1000), (None, 10), ("a", 100), ("c", 500)])
    assert got["a"] == 300 and got[None] == 30
    left = 1610 - 330
    assert got["b"] == pytest.approx(left * 2 / 3) and got["c"] == pytest.approx(left / 3)


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 200))), "en", None if i % 9 == 0 else f"s{i % 4 if i % 3 else 0}") for i in range(900)]
    rows += [(5, None, None, "empty"), (6, "", None, "empty")]
    docs = frame(spark, rows)
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    for block_rows in (5000, 40):
        got = mixing.mix(sized, block_rows=block_rows).collect()
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(sized, block_rows=block_rows).collect()))
        assert len(got) == len(rows)
        for s in {r["source"] for r in got}:
            part = [r for r in got if r["source"] == s]
            assert all(r["taken"] <= 3 * r["size"] for r in part)
            assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 20
        sizes = {r[0]: len((r[1] or "").split()) for r in rows if r[3] != "empty"}
        assert all(r["size"] == sizes[r["doc_id"]] for r in got if r["source"] != "empty")


def test_mix_stage_repeats_rows(spark, awkward):
    docs = frame(spark, awkward)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    want = sum(r["copies"] for r in mixing.mix(sized).collect())
    assert out.count() == want


def test_language_id(spark):
    con = duckdb.connect()
    rows = con.execute("select doc_id, text, lang, source from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows += [(90001, None, "en", "a"), (90002, "12 !?", "de", "a"), (90003, "", None, None), (None, rows[0][1], rows[0][2], "a")]
    got = language_id.language_id(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if (r["doc_id"] or 0) > 90000)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 90000]
    assert {r["doc_id"] for r in got if r["held_out"]} == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_counts_equal_brute_force():
    text = "Añb " * 50
    whole = np.zeros(language_id.BUCKETS)
    for bucket, _ in language_id.ngram_buckets(language_id._points(text)):
        whole += np.bincount(bucket, minlength=language_id.BUCKETS)
    weight = np.random.default_rng(0).random((language_id.BUCKETS, 2)).astype(np.float32)
    total = np.zeros((2, 2))
    language_id._score([(0, "x"), (1, text)], weight, total)
    assert np.allclose(total[1], whole @ weight, rtol=1e-4)


def test_language_stage_rejects_only_unidentified(spark, awkward):
    docs = frame(spark, awkward)
    out = language_id.keep_identified(docs)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert ids.isdisjoint({4, 5, 6, 11}) and {1, 2, 9} <= ids


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert jaccard_join.jaccard_classes(none).count() == 0
    assert jaccard_join.keep_class_representatives(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert language_id.language_id(none).count() == 0
    assert language_id.keep_identified(none).count() == 0
