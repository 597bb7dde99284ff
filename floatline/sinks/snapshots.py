"""K3: table snapshots as versioned parquet folders (listing uses the
Hadoop FileSystem of a classic session).

Plain parquet has no MERGE.  An upsert writes the whole new table state to
``<table>/v=<n+1>`` and readers take the highest version, so a path being
read is never overwritten and a failed write leaves the old version intact.
Append-only tables (the incremental filing ingest) use ``append`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    fs, p = _fs(spark, table_dir)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_latest(spark: SparkSession, table_dir: str) -> DataFrame:
    v = versions(spark, table_dir)
    if not v:
        raise FileNotFoundError(f"no committed snapshot under {table_dir}")
    return spark.read.parquet(f"{table_dir}/v={v[-1]}")


def write_snapshot(df: DataFrame, table_dir: str) -> int:
    """Write ``df`` as the next version; returns the version number."""
    v = versions(df.sparkSession, table_dir)
    n = (v[-1] + 1) if v else 1
    df.write.mode("errorifexists").parquet(f"{table_dir}/v={n}")
    return n
