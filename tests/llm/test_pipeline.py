"""The assembled pipeline against a plain version of each stage, and columns whose names clash with the stages' own."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from floatline.llm import exact_dedup, jaccard_join, mixing
from floatline.llm.common import free_names, staged

CLASH = ["_d_id", "_D_DIGEST", "_d_points", "_x_id", "_x_kept", "_x_doc_id", "_d_key", "_j_id", "_j_key", "_m_id", "_m_source",
         "_m_size", "_m_n", "_m_i", "_k_id", "_k_copies", "digest", "kept", "class_id", "copies", "uid", "key"]
LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
WORDS = {"en": [f"word{chr(97 + i)}" for i in range(26)], "de": [f"größe{chr(97 + i)}" for i in range(26)]}


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang], n))
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        out.append((i, prose(lang, int(rng.integers(5, 120))), lang, f"s{i % 3}"))
    base = prose("en", 200)
    changed = base.split()
    changed[100] = "other"
    out += [(100, base, "en", "s0"), (101, base + " \n", "en", "s1"), (102, base, "en", None), (103, " ".join(changed), "en", "s2"),
            (104, None, "en", "s0"), (105, "", "en", "s0"), (106, "12 34 --", "de", "s1"), (107, " \t\n", None, None),
            (108, prose("de", 9000), "de", "s0"), (109, prose("en", 30), None, "s1"), (100, base, "en", "s0"), (None, prose("de", 40), "de", "s2")]
    return [(*r, None if r[1] is None else len(r[1]), *[f"{c} of {n}" for c in CLASH]) for n, r in enumerate(out)]


@pytest.fixture(scope="module")
def stages(spark, rows):
    """Each stage's rows, by name."""
    docs, out = spark.createDataFrame(rows, LAYOUT).repartition(3), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, None), f"test-{name}")
        out[name] = docs
    return out


def _tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def _after_near(rows):
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    for r in letters:
        rank = (-len(r[1]), r[0] is None, r[0] or 0)
        if normalised(r[1]) not in first or rank < first[normalised(r[1])][0]:
            first[normalised(r[1])] = (rank, r)
    exact = [r for _, r in first.values()]
    sets = [shingles(r[1]) for r in exact]
    root = list(range(len(exact)))
    for _ in exact:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = min(root[i], root[j])
    near = [r for i, r in enumerate(exact) if r[0] is None or r[0] == min(exact[j][0] for j in range(len(exact)) if root[j] == root[i] and exact[j][0] is not None)]
    return letters, exact, near


def test_filtering_stages_equal_the_plain_version(stages, rows):
    letters, exact, near = _after_near(rows)
    key = lambda r: str((r[0], r[1]))
    # Of whole rows repeated either may stay: their own columns differ, so ids and texts are compared, then the rows are looked up.
    for name, want in (("language_id", letters), ("exact_dedup", exact), ("jaccard_join", near)):
        got = stages[name]
        assert got.columns == [c.split(" ")[0].strip("`") for c in LAYOUT.split(", ")]
        got = _tuples(got)
        assert sorted(map(key, got)) == sorted(map(key, want)), name
        assert set(got) <= set(rows), name
    assert len(near) < len(exact) < len(letters) < len(rows)


def test_mix_stage_repeats_whole_rows_to_their_targets(stages, rows):
    near, mixed = _tuples(stages["jaccard_join"]), _tuples(stages["mixing"])
    assert set(mixed) <= set(near)
    size = lambda r: len((r[1] or "").split())
    sums = {}
    for r in near:
        sums[r[3]] = sums.get(r[3], 0) + size(r)
    for source, target in mixing.targets(list(sums.items())).items():
        took = sum(size(r) for r in mixed if r[3] == source)
        assert abs(took - target) <= max(size(r) for r in near if r[3] == source)
    assert all(mixed.count(r) <= 3 for r in near)


def test_pack_stage_holds_every_token_once(stages):
    mixed, pieces = _tuples(stages["mixing"]), stages["packing"].collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids = [*encode.encode(r[1] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cut = [ids] if len(ids) <= 2048 else [ids[:head], *[ids[i:i + 2048] for i in range(head, len(ids), 2048)]]
        want += [(len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for p in cut]
    assert sorted((p["length"], p["ids_crc32"]) for p in pieces) == sorted(want)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_equals_its_stages(spark, rows, stages, tmp_path):
    spark.createDataFrame(rows, LAYOUT).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = lambda df: _tuples(df.select("doc_id", "piece", "start", "length", "ids_crc32"))
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(stages["packing"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], LAYOUT).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_free_names(spark):
    docs = spark.createDataFrame([], "`_D_id` int, `_d_id_` int")
    assert free_names(docs, "_d_id", "_d_id", "other") == ["_d_id__", "_d_id___", "other"]


@pytest.mark.parametrize("stage", [exact_dedup.keep_first, jaccard_join.keep_class_representatives])
def test_user_columns_are_returned_as_they_came(spark, stage):
    docs = spark.createDataFrame([(1, "a text of some few words", "keep1", "x"), (2, "another text that has its own words", "keep2", "y")],
                                 "doc_id long, text string, _d_id string, _d_key string")
    assert sorted(map(tuple, stage(docs).collect())) == sorted(map(tuple, docs.collect()))
