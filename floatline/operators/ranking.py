"""Top-1 per key and stable id assignment.

``first_per_key`` is ``row_number() = 1`` over a window.  Spark (>= 3.5)
plans it with a partial ``WindowGroupLimit`` *before* the shuffle, so every
map task forwards at most one row per key: a key holding a third of the
rows costs one row per task in the exchange, not a third of the data in one
task.

``assign_ids`` numbers rows in a global order without a single-partition
window: rows are sorted by range and written with their partition and their
index inside it (which fixes both, and cuts lineage so a lost executor
recomputes nothing upstream); per-partition offsets come from a table with one
row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floatline.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key group under ``order`` (ties must be
    broken by the caller with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def assign_ids(df: DataFrame, order: list[Column], start, id_col: str = "id") -> DataFrame:
    """Add ``id_col`` = start + 1, start + 2, ... following ``order``.

    ``start`` is the current maximum id (see ``max_id``).  Order must be total.
    """
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    numbered = materialize(df.orderBy(*order).withColumn("_pid", part).withColumn("_local", local))
    # One row per partition: bounded by the partition count, safe to broadcast.
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
    out = numbered.join(F.broadcast(offsets.select("_pid", "_offset")), "_pid")
    out = out.withColumn(id_col, F.lit(int(start)).cast("long") + F.col("_offset") + F.col("_local") + 1)
    return out.drop("_pid", "_local", "_offset")


def max_id(df: DataFrame, col: str = "id") -> int:
    """Current max(id), 0 when empty: one scalar, the start for assign_ids."""
    return int(df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).first()[0])
