"""K1/K2: report files.

A CSV folder per report with a header, fixed column order, nulls as empty
fields, booleans spelled True/False, numbers as Python's ``repr`` spells them
(``15276527.0``, ``1e+16``) and quotes doubled, so any CSV reader gets the
values back.  Rows keep the report's order; a large report is several part
files in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_double(c: Column) -> Column:
    """A double as text: shortest digits, plain notation from 1e-4 up to
    1e16, else with a signed two-digit exponent; NaN is empty."""
    size = F.abs(c)
    digits = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    raw = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(raw, r"E(-?[0-9]+)$", 1)
    exponent = F.concat(F.when(power.startswith("-"), F.lit("-")).otherwise(F.lit("+")),
                        F.lpad(F.regexp_replace(power, "-", ""), 2, "0"))
    return (F.when(F.isnan(c), F.lit(None).cast("string")).when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((size == 0) | size.between(1e-4, 9999999999999998.0), plain)
            .otherwise(F.concat(mantissa, F.lit("e"), exponent)))


def csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = plain_double(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_report(df: DataFrame, path: str) -> None:
    (csv_ready(df).write.mode("overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A written report with the types of ``schema``; empty fields are null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (spark.read.schema(text).option("header", True).option("escape", '"').option("multiLine", True)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def export(reports: dict[str, DataFrame], out_dir: str) -> dict:
    """Write every report; return {exported_files, row_counts} (K2).  Rows
    are counted as they are written: each report runs once."""
    files, counts = [], {}
    for name, df in reports.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        written = Observation(name)
        write_report(df.observe(written, F.count(F.lit(1)).alias("rows")), path)
        files.append(path)
        counts[name] = written.get.get("rows", 0)
    return {"exported_files": files, "row_counts": counts}


def row_counts(reports: dict[str, DataFrame]) -> DataFrame:
    """K2 as a DataFrame: one (report, rows) row per report."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows")
             for name, df in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
