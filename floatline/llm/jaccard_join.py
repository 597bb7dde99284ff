"""N-gram Jaccard self-join by a MinHash LSH forest (operator 10).

Two texts are linked when the Jaccard similarity of their sets of 5-word
shingles is at least 0.8.  Words are runs of bytes other than space, TAB, LF,
VT, FF and CR; case and punctuation count.  A text of 1 to 4 words has one
shingle, all its words.

1. Equal texts are one class (a key from the text's digest); everything
   below works on one text of each class, with the class size as its weight.
2. Every text gets one MinHash signature per tree.  A tree is the sorted
   prefix trie of its signatures; the depth of the matched prefix is shortened
   from ``DEPTH`` until a pair at the threshold meets in some tree with the
   target probability (``forest_depth``).  A trie node is linked as a star to
   its smallest text (map-side combined), never as all pairs.
3. Components of these stars are the candidate groups: any two texts that
   share a trie node are in one group.  Each group is verified exactly, by
   intersecting shingle sets; groups of more than ``BLOCK`` texts are split
   into pairs of blocks, so no task holds a whole large group.  No candidate is
   dropped.  Only links and block-wise spanning edges leave the tasks.
4. Classes are the components of the verified links.

Defined results: a null, empty or blank text has no shingles and no links.
Repeated rows are copies like any others.  class_id is the smallest doc_id of
the class (null only if all are); n_links counts other documents linked to
this one, copies included.  Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatline.llm.common import components, free_names, maybe_in, shuffle_partitions, staged, table, text_input, text_key
from floatline.llm.vectext import batches, shingles, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
TARGET_RECALL = 0.995
BLOCK = 256
PACK_ROWS = 1000


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                 target: float = TARGET_RECALL) -> int:
    """Longest matched prefix whose recall at the threshold reaches the target."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _prefixes(trees: int, depth: int):
    """Per text: a 64-bit key of its first ``depth`` signature values in every tree."""
    mult = _multipliers(trees * depth)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            keys = np.zeros((n, trees), np.uint64)
            count = np.zeros(n, np.int64)
            for first, end, data, off in batches(part.column("text")):
                sh, doc, _ = shingles(*word_hashes(data, off), SHINGLE)
                if not len(sh):
                    continue
                at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                rows = first + doc[at]
                count[rows] = np.diff(np.r_[at, len(sh)])
                key = np.zeros((len(at), trees), np.uint64)
                for j in range(trees * depth):
                    low = np.minimum.reduceat(sh * mult[j], at)
                    t = j // depth
                    key[:, t] = (key[:, t] ^ (low >> np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
                    key[:, t] ^= key[:, t] >> np.uint64(29)
                keys[rows] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees),
                                             pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(count), lists],
                                             names=["doc_id", "key", "n_shingles", "prefixes"])
    return run


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each text by the sorted distinct hashes of its shingles."""
    for part in parts:
        out: list[bytes] = [b""] * part.num_rows
        for first, end, data, off in batches(part.column("text")):
            sh, doc, _ = shingles(*word_hashes(data, off), SHINGLE)
            cut = np.searchsorted(doc, np.arange(end - first + 1))
            for i in range(end - first):
                out[first + i] = np.unique(sh[cut[i]:cut[i + 1]]).tobytes()
        yield pa.RecordBatch.from_arrays([c for name, c in zip(part.schema.names, part.columns) if name != "text"]
                                         + [pa.array(out, pa.binary())],
                                         names=[n for n in part.schema.names if n != "text"] + ["shingles"])


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard of every two sets >= threshold (exact)."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    # items of one set only add nothing to any intersection
    shared = np.bincount(item)[item] > 1
    owner, item = owner[shared], item[shared]
    _, item = np.unique(item, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (8 << 20) // max(1, len(sets)))
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    for low in range(0, int(item.max()) + 1 if len(item) else 0, width):
        a, b = np.searchsorted(item, [low, low + width])
        x = np.zeros((len(sets), min(width, int(item[b - 1]) - low + 1)), np.float32)
        x[owner[a:b], item[a:b] - low] = 1
        both += x @ x.T
    union = size[:, None] + size[None, :] - both
    return (both >= threshold * union - 1e-6) & (both > 0)


def _roots(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index."""
    root = np.arange(len(link))
    while True:
        low = np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        # a pack holds whole small groups, or one pair of blocks of a large one
        for _, part in pdf.groupby("root", sort=False):
            part = part.drop_duplicates("uid")
            link = similar_pairs([np.frombuffer(s, np.uint64) for s in part["shingles"]], threshold)
            np.fill_diagonal(link, False)
            side = part["block"].to_numpy()
            lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
            if lo != hi:  # links inside a block are counted by its own task
                link &= side[:, None] != side[None, :]
            weight = part["weight"].to_numpy()
            keys = part["uid"].to_numpy()
            out.append(pd.DataFrame({"uid": keys, "links": link @ weight, "to": keys[_roots(link)]}))
        return pd.concat(out)
    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                    target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, class_size, n_links, text_key for every document."""
    spark = docs.sparkSession
    docs = text_input(docs)
    depth = forest_depth(threshold, trees, DEPTH, target)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    rows = staged(keyed.mapInArrow(_prefixes(trees, depth),
                                   "doc_id long, key binary, n_shingles long, prefixes array<long>"), "forest")
    texts = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first_id"),
                                           F.max("n_shingles").alias("n_shingles"), F.first("prefixes").alias("prefixes"))
                   .withColumn("uid", F.monotonically_increasing_id()), "texts")  # a number per text, fixed by the write
    nodes = texts.where("n_shingles > 0").select("uid", F.posexplode("prefixes").alias("tree", "prefix"))
    star = staged(nodes.groupBy("tree", "prefix").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "stars")
    met = maybe_in(nodes, ["tree", "prefix"], star)
    edges = met.join(star, ["tree", "prefix"]).select(F.col("uid").alias("a"), F.col("hub").alias("b"))
    groups = components(edges)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = staged(groups.withColumnRenamed("node", "uid").join(sizes, "root")
                     .join(texts.select("uid", "key", "weight", "first_id"), "uid")
                     .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")), "members")
    n_members = members.count()
    # Fetch the sets of the candidates; the text is replaced as soon as it arrives.
    m = members.select(F.col("key").alias("m_key"), "first_id", "uid", "root", "blocks", "block", "weight")
    near = maybe_in(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), "key", members)
    sets = (near.join(m, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
            .select("uid", "root", "blocks", "block", "weight", "text"))
    sets = staged(sets.mapInArrow(_sets, "uid long, root long, blocks int, block int, weight long, shingles binary"), "sets")
    packs = max(1, n_members // PACK_ROWS)
    split = (sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))
    pack = F.when(F.col("blocks") == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string"))) \
            .otherwise(F.concat_ws("|", "root", "lo", "hi"))
    checked = staged(split.withColumn("pack", pack).repartition(shuffle_partitions(spark), "pack").groupBy("pack")
                     .applyInPandas(_verify(threshold), "uid long, links long, to long"), "links")
    links = checked.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("uid").alias("a"), F.col("to").alias("b")).distinct())
    per_text = (texts.drop("prefixes").join(links, "uid", "left").join(classes.withColumnRenamed("node", "uid"), "uid", "left")
                .select("key", "weight", "first_id", "n_shingles", F.coalesce("root", "uid").alias("root"),
                        F.coalesce("links", F.lit(0)).alias("links")))
    per_class = per_text.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("weight").alias("class_size"))
    per_text = staged(per_text.join(per_class, "root"), "classes")
    out = rows.select("doc_id", "key").join(per_text.select(
        "key", "class_id", "class_size", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "n_shingles"), "key")
    blank = F.col("n_shingles") == 0
    return out.select("doc_id", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(blank, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
                      F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      F.col("key").alias("text_key"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


def keep_class_representatives(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id (of repeated
    rows with that doc_id, one).  Blank texts and null doc_ids stay."""
    found = staged(jaccard_classes(docs), "fates")
    d_id, d_key, j_id, j_key, j_n, j_r = free_names(docs, "_d_id", "_d_key", "_j_id", "_j_key", "_j_n", "_j_r")
    drop = found.where("doc_id <> class_id").select(F.col("doc_id").alias(j_id), F.col("text_key").alias(j_key)).distinct()
    keyed = docs.withColumns({d_id: F.col("doc_id").cast("long"), d_key: text_key(F.col("text"))})
    out = keyed.join(drop, (F.col(d_id) == F.col(j_id)) & (F.col(d_key) == F.col(j_key)), "left_anti")
    again = found.where("doc_id = class_id AND class_size > 1").groupBy("class_id").agg(F.count(F.lit(1)).alias(j_n)) \
        .where(F.col(j_n) > 1).select(F.col("class_id").alias(j_id))
    if again.limit(1).count():  # rows that share the doc_id that stays: the first text of them stays
        w = Window.partitionBy(d_id).orderBy(d_key)
        one = out.join(again, F.col(d_id) == F.col(j_id), "left_semi").withColumn(j_r, F.row_number().over(w)) \
            .where(F.col(j_r) == 1).drop(j_r)
        out = out.join(again, F.col(d_id) == F.col(j_id), "left_anti").unionByName(one)
    return out.select(*docs.columns)
