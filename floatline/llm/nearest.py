"""Approximate nearest neighbours over shifted Hilbert curves (operator 7).

Nearness is the inner product in double precision.  Vectors are lengthened to
one norm by an extra component (queries get 0 there), so that a larger inner
product is a smaller angle.  Each of ``CURVES`` curves projects them on
``DIMS`` random directions, shifts the grid, and orders them by their Hilbert
key.  Spark range-partitions the orders; a query is compared with the
``window`` rows on either side of its place in every order, block by block
as matrix products, and its candidates of all curves are merged and reranked
by the exact measure.

The window is measured, not guessed: for ``SAMPLE`` queries the true
neighbours are found by brute force over all vectors, and the window is the
smallest that holds the target share of them in at least one order.
Structured data need a small part of each order, data without structure a
large one; the recall stays.

Equal vectors are one class (its 21 smallest vec_ids are kept, more can never
be answers), so a vector repeated any number of times is one row in the
orders.  A class carries its smallest vec_id, and every cut is made by (score,
that vec_id), so of the candidates compared ties go to the smaller vec_id exactly.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as queries or candidates; neither do those of
another length than the most common one (the longer on a tie).  Rows that repeat a vec_id are one
candidate if their vectors are equal, and separate rows else.  With fewer
candidates than asked for, all are returned.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatline.llm.common import staged, table

CURVES = 6
DIMS = 6
BITS = 10
SAMPLE = 64
TARGET_RECALL = 0.95
BLOCKS = 16          # of an order, at least
BLOCK_ROWS = 1 << 16  # of an order, at most
QUERY_ROWS = 1 << 14  # in one product, at most
FOUND = "q long, cid long, score double, least long"


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows; ``bits`` bits each):
    Gray-code the axes from the top bit down, rotating as the curve turns."""
    x = [grid[:, j].astype(np.int64).copy() for j in range(grid.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for j in range(len(x)):
            flip = (x[j] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[j]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if j:
                x[j] = x[j] ^ swap
        q >>= 1
    for j in range(1, len(x)):
        x[j] ^= x[j - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Hilbert keys of vectors of norm 1 on one of the shifted, rotated grids."""
    rng = np.random.default_rng(1000 + curve)
    axes = np.linalg.qr(rng.normal(size=(unit.shape[1], min(DIMS, unit.shape[1]))))[0]
    spread = 3.0 / np.sqrt(unit.shape[1])  # nearly all of a projection of evenly spread vectors
    place = (unit @ axes + spread) / (2 * spread) * 0.75 + rng.random(axes.shape[1]) * 0.25
    return hilbert_key(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _lengthen(v: np.ndarray, norm: float) -> np.ndarray:
    v = v / norm
    return np.c_[v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))]


def _orders(norm: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            ids, asks = pdf["cid"].to_numpy(), pdf["asks"].to_numpy(bool)
            unit = _lengthen(v, norm)
            q = v[asks]
            query = np.c_[q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(q))]
            for c in range(CURVES):
                yield pd.DataFrame({"curve": c, "key": np.r_[curve_keys(unit, c), curve_keys(query, c)],
                                    "cid": np.r_[ids, ids[asks]], "query": np.r_[np.zeros(len(ids), bool), np.ones(len(q), bool)]})
    return run


def _nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, least: np.ndarray) -> pd.DataFrame:
    """The k best rows of ``v`` for each query, of equal scores those with the
    smaller ``least`` (smallest vec_id of the class)."""
    out = []
    v_norm = np.sqrt((v * v).sum(axis=1)).max(initial=0.0)
    for at in range(0, len(q), 256):
        ask = q[at:at + 256]
        scores = ask @ v.T
        row, col = np.divmod(np.arange(scores.size), max(1, len(v)))
        if len(v) > k:
            # Products of a matrix differ from sums of pairs in the last places:
            # all that may tie with the k-th are summed again, then cut.
            slack = 4 * v.shape[1] * np.finfo(float).eps * v_norm * np.sqrt((ask * ask).sum(axis=1))
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(scores >= (kth - slack)[:, None])
        exact = np.concatenate([(ask[row[i:i + 65536]] * v[col[i:i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((least[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pd.DataFrame({"q": qid[at:at + 256][row[kept]], "cid": ids[col[kept]], "score": exact[kept], "least": least[col[kept]]}))
    return pd.concat(out)


def _compare(k: int):
    def run(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"q": [], "cid": [], "score": [], "least": []}).astype({"q": "int64", "cid": "int64", "score": "float64", "least": "int64"})
        return _nearest(ask["cid"].to_numpy(), np.stack(ask["v"].to_numpy()).astype(float),
                        data["cid"].to_numpy(), np.stack(data["v"].to_numpy()).astype(float), k, data["least"].to_numpy())
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best classes of each query class, ties to the smaller vec_id; each pair once."""
    once = found.groupBy("q", "cid").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "least", "cid"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r", "least")


def classes_of(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, int]:
    """(classes of equal vectors, dimension): cid, v, ids (the k + 1 smallest
    vec_ids), least (the smallest of them; nulls last), asks (holds a query)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0)
                & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    # 0.0 and -0.0 are one value
    v = v.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("vec_id").asc_nulls_last()))
    few = v.dropDuplicates(["vec_id", "h"]).withColumn("r", rank).where(F.col("r") <= k + 1)
    groups = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("least"))
    asking = v.where((F.col("vec_id") % every == 0)).select("h").distinct().withColumn("asks", F.lit(True))
    out = groups.join(asking, "h", "left").select("h", "v", "ids", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"),
                                                  F.coalesce("asks", F.lit(False)).alias("asks"))
    return staged(out.withColumn("cid", F.monotonically_increasing_id()), "classes"), dim


def numbered(orders: DataFrame) -> tuple[DataFrame, int]:
    """Rows of every curve numbered along it; (orders with rank, rows of a curve)."""
    keys = ["curve", "key", "cid", "query"]
    n = max(CURVES, 2 * orders.sparkSession.sparkContext.defaultParallelism)
    ranked = staged(orders.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "orders")
    counts = ranked.groupBy("part", "curve").agg(F.count(F.lit(1)).alias("n"), F.min("local").alias("least")).orderBy("curve", "part").collect()
    offset, rows = {}, {}
    for r in counts:  # a row a partition and curve
        offset[r["part"], r["curve"]] = rows.get(r["curve"], 0) - r["least"]
        rows[r["curve"]] = rows.get(r["curve"], 0) + r["n"]
    table_ = orders.sparkSession.createDataFrame([(p, c, o) for (p, c), o in offset.items()], "part int, curve int, offset long")
    out = ranked.join(F.broadcast(table_), ["part", "curve"]).select("curve", "cid", "query", (F.col("local") + F.col("offset")).alias("rank"))
    return out, max(rows.values(), default=0)


def measure_window(classes: DataFrame, ranks: DataFrame, k: int, target: float, sample: int = SAMPLE) -> tuple[int, float]:
    """(window, recall on the sample): true neighbours of some query classes by
    brute force, and how far from their query they are in the best order."""
    spark = classes.sparkSession
    drawn = classes.where("asks").orderBy(F.xxhash64("h")).limit(sample).select("cid", "v").collect()
    qid = np.array([r["cid"] for r in drawn], np.int64)
    q = np.array([r["v"] for r in drawn], float)

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield _nearest(qid, q, pdf["cid"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float), k + 1, pdf["least"].to_numpy())

    true = _best(classes.select("cid", "v", "least").mapInPandas(brute, FOUND), k + 1).where("q <> cid").select("q", "cid")
    # at most sample * (k + 1) pairs, on every curve
    here = ranks.where("query").select(F.col("cid").alias("q"), "curve", F.col("rank").alias("qrank"))
    there = ranks.where("NOT query").select("cid", "curve", "rank")
    far = (F.broadcast(true).join(here, "q").join(there, ["cid", "curve"])
           .groupBy("q", "cid").agg(F.min(F.abs(F.col("rank") - F.col("qrank"))).alias("far")).select("far").collect())
    far = np.sort([r["far"] for r in far])
    if not len(far):
        return 1, 1.0
    at = min(len(far) - 1, int(np.ceil(target * len(far))) - 1)
    return int(far[at]) + 1, float(np.mean(far <= far[at]))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose
    vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    classes, dim = classes_of(vectors, every, k)
    norm = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    layout = "query_id long, rank int, vec_id long, score double"
    if norm is None or not classes.where("asks").limit(1).count():
        return spark.createDataFrame([], layout)
    orders = classes.select("cid", "v", "asks").mapInPandas(_orders(float(np.sqrt(norm))), "curve int, key long, cid long, query boolean")
    ranks, n = numbered(orders)
    ranks = staged(ranks, "ranks")
    window, _ = measure_window(classes, ranks, k, target)
    blocks = max(BLOCKS, -(-n // BLOCK_ROWS))
    size = max(1, -(-n // blocks))
    n_asks = classes.where("asks").count()
    chunks = max(1, -(-int(n_asks * min(1.0, (2 * window + size) / n)) // QUERY_ROWS))
    vec = classes.select("cid", "v", "least")
    data = ranks.where("NOT query").select("curve", F.floor(F.col("rank") / size).alias("block"), "cid") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    low = F.greatest(F.lit(0), F.floor((F.col("rank") - window) / size))
    high = F.least(F.lit(blocks - 1), F.floor((F.col("rank") + window) / size))
    ask = ranks.where("query").select("curve", "cid", F.explode(F.sequence(low, high)).alias("block"),
                                      F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int").alias("chunk"))
    keys = ["curve", "block", "chunk"]
    n_parts = max(2 * spark.sparkContext.defaultParallelism, CURVES * blocks * chunks // 4)
    data = data.join(vec, "cid").repartition(n_parts, *keys)
    ask = ask.join(vec.drop("least"), "cid").select(*[F.col(c).alias(c) for c in (*keys, "cid", "v")]).repartition(n_parts, *keys)
    found = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(_compare(k + 1), FOUND)
    best = staged(_best(staged(found, "candidates"), k + 1), "nearest")
    members = classes.select("cid", "ids")
    # every query of a query class: not only its smallest ids
    v = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id") % every == 0)
    asking = v.withColumn("h", F.xxhash64(F.transform("e", lambda x: x + 0.0))).join(classes.where("asks").select("h", F.col("cid").alias("q"), "v"), "h") \
        .where(F.transform("e", lambda x: x + 0.0) == F.col("v")).select("query_id", "q").distinct()
    pairs = best.join(members, "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = asking.join(pairs, "q").where("vec_id IS NULL OR vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
