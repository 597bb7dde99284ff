"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floatline.session import ensure_checkpoint_dir, parallelism

# The white space of every text contract here: space, TAB, LF, VT, FF, CR.
WHITE_SPACE = " \t\n\x0b\x0c\r"


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it:
    its sources go to the executors once per context, as ``--py-files`` would.
    Spark notes the shipped files when a Python function is put into a plan, so
    every public operator calls this first.

    Also bounds the batches that travel to them: whole texts make the default
    10,000 rows tens of MB, held several times over beside the executor's heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_floatline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="floatline-src-"), "floatline_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._floatline_shipped = True


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it is
    computed once, and a lost executor recomputes nothing upstream of it.
    ``free``: the shuffle files of the write go when it has ended, not when the
    driver happens to collect its garbage."""
    spark = df.sparkSession
    ship_package(spark)
    path, before = shared_path(spark, label), spark.conf.get(FREED, "false")
    if free:
        spark.conf.set(FREED, "true")
        df = df.select("*")  # notes the setting
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(FREED, before)
    return _read(spark, df.schema, [path])


def _read(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    df = spark.read.schema(schema).parquet(*paths)
    df._staged = paths
    return df


def together(frames: list[DataFrame]) -> DataFrame:
    """The rows of several tables that ``staged`` wrote, of one layout."""
    return _read(frames[0].sparkSession, frames[0].schema, [path for df in frames for path in df._staged])


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``staged`` wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, df._staged):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(df: DataFrame, on: list[str], size: Column, room: int) -> Iterator[DataFrame]:
    """``df`` in as many parts, by a hash of ``on``, as leave about ``room`` bytes a part, of rows of ``size`` bytes."""
    n = -(-int(df.agg(F.sum(size)).first()[0] or 0) // room)
    part = F.pmod(F.xxhash64(F.lit(",".join(on)), *on), F.lit(n))
    yield from [df] if n < 2 else (df.where(part == k) for k in range(n))


def shuffle_partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, 2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null as empty): equal texts, equal key."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def text_input(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) of any document table; other columns are ignored."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, root), root the smallest
    node of the component; nodes without an edge do not appear.

    Min-label propagation with pointer jumping.  Every round is a pair of
    joins plus a map-side combined ``min`` and is written to the shared
    folder, so hub nodes cost one row per task and lineage stays short.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = staged(e.union(e.select("y", "x")).distinct(), "edges")
    labels = staged(e.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = (e.join(labels.withColumnRenamed("node", "y"), "y")
                 .groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        hop = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = staged(step.join(hop, "next").select("node", F.least("next", "far").alias("next"), "root"), "labels")
        changed = step.where("next <> root").limit(1).count()
        labels = step.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


BITMAP_BITS = 1 << 25


def maybe_in(df: DataFrame, on: str | list[str], wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``wanted``; none that is
    gets lost.  A bitmap of hashed keys is broadcast: 1,024 rows of 4 KB at
    most, whatever the number of keys, so it only gets less selective."""
    on = [on] if isinstance(on, str) else on
    h = F.pmod(F.xxhash64(*on), F.lit(BITMAP_BITS))
    bits = wanted.select(h.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    probe = df.withColumn("_h", h).withColumn("_bucket", F.bitmap_bucket_number("_h"))
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position("_h") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.bitmap_bit_position("_h") % 8).cast("int")) != 0
    return probe.join(F.broadcast(bits), "_bucket").where(hit).select(*df.columns)


VECTOR_LAYOUT = "slice int, shard long, vec binary"


def _fold(dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for pdf in batches:
            for part, shard, vec in zip(pdf["slice"], pdf["into"], pdf["vec"]):
                if key != (part, shard):
                    if key is not None:
                        yield pd.DataFrame({"slice": [key[0]], "shard": [key[1]], "vec": [total.tobytes()]})
                    key, total = (part, shard), np.frombuffer(vec, dtype).copy()
                else:
                    total += np.frombuffer(vec, dtype)
        if key is not None:
            yield pd.DataFrame({"slice": [key[0]], "shard": [key[1]], "vec": [total.tobytes()]})
    return run


def tree_sum(parts: DataFrame, dtype: str, fan: int = 16) -> DataFrame:
    """Dense vectors (slice, shard, vec) added up slice by slice in two levels:
    first into ``fan`` sums a slice, then into one.  A task holds one slice at a
    time and adds shards in their order, so equal input gives equal floats."""
    ship_package(parts.sparkSession)
    for into in (F.col("shard") % fan, F.lit(0).cast("long")):
        parts = (parts.withColumn("into", into).repartition("slice", "into")
                 .sortWithinPartitions("slice", "into", "shard").mapInPandas(_fold(dtype), VECTOR_LAYOUT))
    return parts.select("slice", "vec")


def gathered(sums: DataFrame, size: int, step: int, dtype: str) -> np.ndarray:
    """The whole vector of ``size`` entries on the driver; its size is fixed by a model's parameters.
    It comes a partition at a time, so that the driver does not hold all slices beside it."""
    out = np.zeros(size, dtype)
    for part, vec in sums.select("slice", "vec").toLocalIterator():
        out[part * step:part * step + len(vec) // out.itemsize] = np.frombuffer(vec, dtype)
    return out


def slices(shard: int, vec: np.ndarray, step: int) -> Iterator[pd.DataFrame]:
    """Rows of ``tree_sum``'s input for one dense vector, empty slices left out."""
    for at in range(0, len(vec), step):
        part = vec[at:at + step]
        if part.any():
            yield pd.DataFrame({"slice": [at // step], "shard": [shard], "vec": [part.tobytes()]})


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it (Spark
    compares names without case), so that a column added beside them replaces none."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
