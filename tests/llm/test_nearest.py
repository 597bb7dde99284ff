"""Operator 7: the curve itself, exactness on small data, recall, defined results."""

import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from floatline.llm import nearest

LAYOUT = "vec_id long, embedding array<float>, label int, key string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], LAYOUT)


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-float((q * v).sum()), j) for j, v in ok if j != i)[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_hilbert_neighbours_are_adjacent():
    """Consecutive keys are cells one step apart, and every cell has its own key."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = nearest.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_small_table_with_ties_is_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 60 if i < 120 else 7]]) for i in range(200)]  # vector 7 is very common
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7),
             (1080, [float("inf")] + [1.0] * 7), (1100, [1.0] * 3), (1120, [])]
    got, want = answers(nearest.nearest(frame(spark, rows), target=1.0)), brute([r for r in rows if r[1] and len(r[1]) == 8])
    assert got.keys() == want.keys()
    for q in want:
        assert [(a, b) for a, b, _ in got[q]] == [(a, b) for a, b, _ in want[q]]
        assert np.allclose([s for *_, s in got[q]], [s for *_, s in want[q]], atol=1e-12)


def test_ties_of_different_vectors_go_to_the_smaller_id(spark, monkeypatch):
    """Vectors of +-1 have few different scores; every candidate is compared."""
    monkeypatch.setattr(nearest, "measure_window", lambda classes, ranks, *a, **b: (100_000, 1.0))
    rng = np.random.default_rng(1)
    ids = rng.permutation(3000)[:1200]
    rows = [(int(i), [float(x) for x in rng.choice([-1.0, 1.0], size=12)]) for i in ids]
    got, want = answers(nearest.nearest(frame(spark, rows))), brute(rows)
    assert got == want and len(got) > 40


def test_ties_of_inexact_products_are_summed_before_the_cut():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 24))
    v = np.concatenate([base, -base, base[:, ::-1]])
    least = rng.permutation(len(v)).astype(np.int64)
    out = nearest._nearest(np.arange(300), v[:300], np.arange(len(v)), v, 7, least)
    for q, rows in out.groupby("q"):
        exact = (v[q] * v).sum(axis=1)
        assert rows["cid"].tolist() == np.lexsort((least, -exact))[:7].tolist()
        assert rows["score"].tolist() == np.sort(exact)[::-1][:7].tolist()


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [-1.0, 0.0])]
    assert answers(nearest.nearest(frame(spark, rows))) == {0: [(1, 1, 0.5), (2, 3, -1.0)]}


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    got = answers(nearest.nearest(spark.read.parquet(path).withColumn("curve", F.lit(1))))
    want = brute(duckdb.sql(f"select vec_id, embedding from '{path}'").fetchall())
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j, _ in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_clustered_data_need_a_small_window(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(100, 16))
    rows = [(i, [float(x) for x in (centre[i % 100] + rng.normal(size=16) * 0.02) / np.linalg.norm(centre[i % 100])]) for i in range(4000)]
    classes, _ = nearest.classes_of(frame(spark, rows), 20, 20)
    orders = classes.select("cid", "v", "asks").mapInPandas(nearest._orders(1.2), "curve int, key long, cid long, query boolean")
    ranks, n = nearest.numbered(orders)
    window, recall = nearest.measure_window(classes, ranks, 20, 0.95)
    assert n == 4200 and window < 400 and recall >= 0.95


def test_empty_and_without_queries(spark):
    assert nearest.nearest(frame(spark, [])).count() == 0
    assert nearest.nearest(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert nearest.nearest(frame(spark, [(0, [1.0, 2.0])])).count() == 0
