"""Partitioning for CPU-heavy text work.

Text is worked on in the stage that scans it: a large table has more input
splits than the cluster has cores, and moving the texts would cost more than
it wins.  Only a table in fewer files than cores (a laptop, a test) is dealt
out first, so that its few splits do not leave cores idle; the rows are the
same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floatline.session import parallelism


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """``df`` (a plain table read) as it is, or dealt out by ``key`` if it lies
    in fewer files than the cluster has cores."""
    cores = parallelism(df.sparkSession)
    return df if len(df.inputFiles()) >= cores else df.repartition(2 * cores, key)


SMALL_ROWS = 20_000  # go to every task: a few MB


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most ``SMALL_ROWS`` rows.  They are counted: Spark
    estimates a table by its compressed file, and exploded rows by it too."""
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def join_small(big: DataFrame, other: DataFrame, small: bool, on, how: str = "inner") -> DataFrame:
    """``big`` joined with ``other``, which goes to every task if it is known to
    be small; else both are shuffled, neither goes through the driver."""
    return big.join(F.broadcast(other), on, how) if small else big.hint("merge").join(other, on, how)
