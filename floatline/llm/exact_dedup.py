"""Exact dedup over a persistent digest index (operator 5, native).

The index is a Parquet table bucketed and sorted by digest in a folder that
outlives the session.  A batch of documents is reduced to one row per digest
(map-side combined, so a group of copies costs one row per task), the digests
already indexed are removed by a sort-merge anti join against the bucketed
table, and the rest is appended.  Only digests move; texts are never shuffled.

Texts are equal when identical after deleting space, TAB, LF, VT, FF and CR;
a null text counts as empty.  Of equal texts in a batch, the row with the most
code points in its original text, then the smallest doc_id (a null doc_id
last) stays.  Repeated rows with the same doc_id and text: exactly one of them
stays.  A digest indexed by an earlier batch keeps that batch's row.
An empty batch appends nothing.  Extra columns are ignored by the index and
kept by ``keep_first``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatline.llm.common import WHITE_SPACE, free_names, shared_path, shuffle_partitions, staged, table

INDEX_COLUMNS = "digest STRING, keep_id BIGINT, n_points INT, group_size BIGINT, batch INT"


def digest_of(text):
    """sha-256 (lower-case hex) of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, digest) per row, computed in the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
                       digest_of(F.col("text")).alias("digest"))


class DigestIndex:
    """Digest index stored at ``path`` (default: a new folder in the shared
    checkpoint folder).  Open it again later, also in another session, by the
    same path and bucket count."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "digest-index")
        self.buckets = buckets or shuffle_partitions(spark)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same entries without their buckets: a join with them is shuffled
        on both sides, so that Spark can split a group of copies over tasks."""
        return self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)

    def ingest(self, rows: DataFrame, batch: int = 0) -> DataFrame:
        """Add the digests of ``rows`` (see ``digests``) that are not indexed
        yet; returns the index entries of this batch."""
        order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), (-F.col("doc_id")).alias("neg"))
        groups = rows.groupBy("digest").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("group_size"))
        fresh = groups.select("digest", (-F.col("top.neg")).alias("keep_id"), F.col("top.n_points").alias("n_points"),
                              "group_size", F.lit(batch).alias("batch"))
        seen = self.entries().select("digest").hint("merge")
        # One task per bucket writes one sorted file.
        fresh.join(seen, "digest", "left_anti").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.entries().where(F.col("batch") == batch)


def decide(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row with the row that stays for its digest: doc_id, keep_id,
    group_size, kept, digest, n_points."""
    # Numbered before the join, so that repeated rows, not equal texts, meet in a task.
    same = Window.partitionBy("doc_id", "digest", "n_points").orderBy(F.lit(1))
    numbered = rows.withColumn("again", F.row_number().over(same))
    joined = numbered.join(entries.select("digest", "keep_id", F.col("n_points").alias("keep_points"), "group_size"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("again") == 1)
    return joined.select("doc_id", "keep_id", "group_size", "n_points", "digest", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0) -> DataFrame:
    """``decide`` for a batch of documents, through the index."""
    index = index or DigestIndex(docs.sparkSession)
    rows = staged(digests(docs), "digests")
    index.ingest(rows, batch)
    return decide(rows, index.files())


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact dedup drops, all columns kept."""
    fate = staged(exact_dedup(docs), "fates").select("doc_id", "n_points", "digest", "kept")
    d_id, d_digest, d_points, x_id, x_points, x_digest, x_kept, x_n = free_names(
        docs, "_d_id", "_d_digest", "_d_points", "_x_id", "_x_points", "_x_digest", "_x_kept", "_x_n")
    per_key = fate.groupBy(F.col("doc_id").alias(x_id), F.col("n_points").alias(x_points), F.col("digest").alias(x_digest)) \
        .agg(F.max("kept").alias(x_kept), F.count(F.lit(1)).alias(x_n))
    keyed = docs.withColumns({d_id: F.col("doc_id").cast("long"), d_digest: digest_of(F.col("text")),
                              d_points: F.length(F.coalesce("text", F.lit("")))})
    match = (F.col(d_digest) == F.col(x_digest)) & F.col(d_id).eqNullSafe(F.col(x_id)) & (F.col(d_points) == F.col(x_points))
    out = keyed.join(per_key.where(~F.col(x_kept)), match, "left_anti")
    repeated = per_key.where(F.col(x_kept) & (F.col(x_n) > 1))
    if repeated.limit(1).count():  # whole rows repeated: one of each goes on
        once = out.join(repeated, match, "left_semi").dropDuplicates([d_digest, d_id, d_points])
        out = out.join(repeated, match, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
