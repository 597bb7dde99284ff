"""Mixing sources to target weights by cube-method sampling (operator 1).

Every source gets a target: its weight's share of all sizes, at most
``max_repeat`` times its own size, the excess reshared by weight.  A document
of a source with ratio r = target / source size is taken floor(r) times, and
once more with probability r - floor(r).  The fractional part is a balanced
sample: the cube method's flight phase moves the vector of inclusion
probabilities along the null space of two balancing equations (the number of
documents, the sum of sizes) until all but two probabilities are 0 or 1.

Flight runs in blocks of at most about ``block_rows`` documents of one source;
the at most eight undecided documents of every block (two that flight leaves,
six kept back) meet in the next round's blocks, so a round shrinks the problem
some hundred times.  When one block a source is left, its last documents (at
most 14) are landed: of their subsets, that nearest to the size still missing
is taken.  A hot source is many blocks.  Texts are read once, to count words; only
(doc_id, source, size) rows move.

Defined results: null text has size 0; a null source is a source of its own,
last in weight order; a source whose sizes sum to 0 takes nothing; repeated
rows are separate documents.  All random choices are seeded by source, block
and round, and rows of a block are sorted first, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatline.llm.common import free_names, staged, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
BLOCK_ROWS = 5000
LANDING = 12  # documents kept back for the landing
EPS = 1e-9


def word_count(text):
    """Runs of characters other than space, TAB, LF, VT, FF and CR; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: list[tuple[str | None, int]], weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> dict:
    """source -> target, for (source, size) pairs."""
    order = sorted(sources, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict = {}
    free = [s for s in size]
    left = float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_repeat * size[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = max_repeat * size[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase with the equations sum(p) and sum(p * size): three
    documents at a time move along their null vector until one is decided.
    Returns probabilities, all but at most two of them 0 or 1."""
    p = prob.copy()
    live: list[int] = []
    coin = rng.random(len(p))
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1,1,1) and to the sizes
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(live, u) if d)
        down = min((p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(live, u) if d)
        step = up if coin[i] * (up + down) < down else -down
        for k, d in zip(live, u):
            p[k] += step * d
            if p[k] < EPS:
                p[k] = 0.0
            elif p[k] > 1 - EPS:
                p[k] = 1.0
        live = [k for k in live if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Decide the few documents ``open_``: of all their subsets, the one whose
    size is nearest to the expected one, then whose count is."""
    want, count = float((p * size)[open_].sum()), float(p[open_].sum())
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(bits @ size[open_] - want)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    best = near[np.abs(bits[near].sum(axis=1) - count).argmin()]
    out = p.copy()
    out[open_] = bits[best]
    return out


def reserve(size: np.ndarray, prob: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` undecided documents of evenly spread sizes, without the
    largest third: they wait for the landing, so that it can meet the total."""
    able = np.flatnonzero((size > 0) & (prob > EPS) & (prob < 1 - EPS))
    able = able[np.argsort(size[able], kind="stable")][:2 * len(able) // 3]
    take = min(most, len(able) // 2)
    return able[np.linspace(0, len(able) - 1, take).astype(int)] if take else able[:0]


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join(map(str, parts)).encode("utf-8", "surrogatepass")))


def _fly(level: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last = pdf["blocks"].iloc[0] <= 1  # all that is left of its source
        pdf = pdf.sort_values(["size", "doc_id", "prob"], ascending=[False, True, True], kind="stable")
        size, prob = pdf["size"].to_numpy(float), pdf["prob"].to_numpy(float)
        wait = reserve(size, prob, LANDING if last else LANDING // 2)
        go = np.setdiff1d(np.arange(len(prob)), wait)
        p = prob.copy()
        p[go] = flight(prob[go], size[go], _seed(seed, level, *key))
        return pdf.assign(prob=land(p, size, np.flatnonzero((p > 0) & (p < 1))) if last else p)
    return run


def mix(sized: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT,
        block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """``sized`` (doc_id, source, size) with source_size, target, copies and taken."""
    sized = staged(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    known = totals.collect()  # one row a source
    want = targets([(r["source"], r["source_size"]) for r in known], weights, max_repeat)
    spark = sized.sparkSession
    plan = []
    for r in known:
        ratio = min(max_repeat, want[r["source"]] / r["source_size"]) if r["source_size"] else 0.0
        whole = math.floor(ratio + EPS)
        plan.append((r["source"], r["source_size"], want[r["source"]], whole, max(0.0, ratio - whole),
                     math.ceil(r["n"] / block_rows)))
    layout = "source string, source_size long, target double, whole int, prob double, blocks long"
    plan_df = spark.createDataFrame(plan, layout).select(F.col("source").alias("_s"), "source_size", "target", "whole", "prob", "blocks")
    open_ = sized.join(F.broadcast(plan_df), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    done = []
    level, blocks = 0, max([p[5] for p in plan], default=1)
    layout = ("doc_id long, source string, size long, source_size long, target double, whole int, "
              "prob double, blocks long, block long")
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "prob", "blocks"]
    while True:
        place = F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.greatest("blocks", F.lit(1)))
        flown = (open_.select(*columns).withColumn("block", place)
                 .groupBy("source", "block").applyInPandas(_fly(level, seed), layout))
        flown = staged(flown, f"flight{level}")
        decided = F.col("prob").isin(0.0, 1.0)
        done.append(flown.where(decided))
        if blocks <= 1:
            break
        # eight undecided documents a block at most
        open_ = flown.where(~decided).withColumn("blocks", F.ceil(F.col("blocks") * 8 / block_rows).cast("long"))
        blocks, level = math.ceil(blocks * 8 / block_rows), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.col("prob").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies,
                      (F.col("size") * (F.col("whole") + F.col("prob").cast("int"))).cast("long").alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (rows it
    does not take are gone); all columns stay.  Rows of one doc_id, source and
    size are alike to the mix; their copies are given out in row order."""
    names = free_names(docs, "_m_id", "_m_source", "_m_size", "_k_id", "_k_source", "_k_size", "_k_copies", "_m_n", "_m_r", "_m_i")
    m_id, m_source, m_size, k_id, k_source, k_size, k_copies, m_n, m_r, m_i = names
    keyed = docs.withColumns({m_id: F.col("doc_id").cast("long"), m_source: F.col("source").cast("string"),
                              m_size: word_count(F.col("text"))})
    sized = keyed.select(F.col(m_id).alias("doc_id"), F.col(m_source).alias("source"), F.col(m_size).alias("size"))
    taken = mix(sized).select("doc_id", "source", "size", "copies")
    per_key = staged(taken.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")), "copies")
    per_key = per_key.select(F.col("doc_id").alias(k_id), F.col("source").alias(k_source), F.col("size").alias(k_size), F.col("copies").alias(k_copies))
    match = (F.col(m_id).eqNullSafe(F.col(k_id)) & F.col(m_source).eqNullSafe(F.col(k_source))
             & (F.col(m_size) == F.col(k_size)))
    joined = keyed.join(per_key, match)
    single = joined.where(F.size(k_copies) == 1).withColumn(m_n, F.col(k_copies)[0])
    repeated = joined.where(F.size(k_copies) > 1)
    w = Window.partitionBy(m_id, m_source, m_size).orderBy(F.xxhash64("text"))
    repeated = repeated.withColumn(m_r, F.row_number().over(w)).withColumn(m_n, F.col(k_copies)[F.col(m_r) - 1])
    out = single.select(*docs.columns, m_n).unionByName(repeated.select(*docs.columns, m_n))
    return (out.where(F.col(m_n) > 0).withColumn(m_i, F.explode(F.sequence(F.lit(1), F.col(m_n))))
            .select(*docs.columns))
