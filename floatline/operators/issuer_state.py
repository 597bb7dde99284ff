"""Mergeable per-issuer state for D8, D10 and R4.

The forms an issuer has filed, its best filing and its latest filing and
offering are all aggregates that merge: a stored row per issuer and a day's
rows give the same state as all rows together.  ``filing_state`` and
``latest_state`` reduce rows to states (map-side), ``merge_states`` joins the
day's states to the stored ones, and ``IssuerStates`` keeps them in a table
partitioned by a bucket of the issuer, of which a merge reads and replaces
the buckets of the day's issuers only.  Merging rows again changes nothing.

The state holds no ``is_parsed`` flag: a flag changes after its filing has
been merged, and is joined by filing id where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floatline.operators.filings import FILING_FORMS, NO_DOWNGRADE, form_tier
from floatline.session import materialize

BEST_COLS = ["id", "form_type", "filing_date", "accession_no", "primary_doc_url"]
# A date as days, latest first; a missing one last.
NO_DATE = 1 << 31


def _latest_first(date: Column) -> Column:
    return F.coalesce(-F.unix_date(date), F.lit(NO_DATE)).cast("long")


def _least(order: list[Column], fields: list[Column], when: Column) -> Column:
    """The row with the least order among those ``when`` holds, as one struct
    that itself compares by that order; null where there is none."""
    return F.min(F.when(when, F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))))


def filing_state(filings: DataFrame) -> DataFrame:
    """issuer_id, rw, filed (D8), best (D10) and latest (R4 of filings, by date) of some filings.

    Rows without accession number or form count for neither status, as in D8."""
    valid = (F.coalesce("accession_no", F.lit("")) != "") & (F.coalesce("form_type", F.lit("")) != "")
    fields = [F.col(c) for c in BEST_COLS]
    late = _latest_first(F.col("filing_date"))
    tier = form_tier(F.col("form_type"))
    return filings.where(F.col("issuer_id").isNotNull()).groupBy("issuer_id").agg(
        F.coalesce(F.bool_or(valid & (F.col("form_type") == "RW")), F.lit(False)).alias("rw"),
        F.coalesce(F.bool_or(valid & F.col("form_type").isin(*FILING_FORMS)), F.lit(False)).alias("filed"),
        _least([tier.alias("tier"), late.alias("late"), F.col("id")], fields, tier.isNotNull()).alias("best"),
        _least([late.alias("late"), F.col("id")], fields, F.lit(True)).alias("latest_filing"))


def latest_state(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """issuer_id and the R4 row (latest ``parsed_at``, then least id) as struct ``name``."""
    order = [_latest_first(F.col("parsed_at")).alias("late"), F.col("id")]
    return rows.where(F.col("issuer_id").isNotNull()).groupBy("issuer_id").agg(
        _least(order, [F.col(c) for c in columns], F.lit(True)).alias(name))


def day_states(filings: DataFrame, offerings: DataFrame, offering_cols: list[str]) -> DataFrame:
    """The states of one day's (or any) filings and offerings together."""
    f, o = filing_state(filings), latest_state(offerings, "latest_offering", offering_cols)
    both = f.join(o, "issuer_id", "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("rw", "filed")})


def merge_states(stored: DataFrame, day: DataFrame) -> DataFrame:
    """The new states of the day's issuers: one row for each row of ``day``.

    Flags are or-ed, the other columns are structs of which the lesser stays."""
    old = stored.select(F.col("issuer_id").alias("_o_issuer"), *[F.col(c).alias(f"_o_{c}") for c in day.columns if c != "issuer_id"])
    j = day.join(old, F.col("issuer_id") == F.col("_o_issuer"), "left")
    kinds = dict(day.dtypes)

    def merged(c: str) -> Column:
        if kinds[c] == "boolean":
            return (F.coalesce(f"_o_{c}", F.lit(False)) | F.col(c)).alias(c)
        return F.least(F.col(f"_o_{c}"), F.col(c)).alias(c)  # nulls are skipped

    return j.select("issuer_id", *[merged(c) for c in day.columns if c != "issuer_id"])


def state_status(states: DataFrame, issuers: DataFrame) -> DataFrame:
    """D8 from the state: issuer_id, old_status, new_status, changed."""
    cur = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("candidate"))
    j = issuers.select(F.col("id").alias("issuer_id"), "status").join(states.select("issuer_id", "rw", "filed"), "issuer_id")
    new = (F.when(F.col("rw"), F.lit("withdrawn")).when(cur.isin(*NO_DOWNGRADE), cur)
           .when(F.col("filed") & (cur != "withdrawn"), F.lit("filed")).otherwise(cur))
    return j.select("issuer_id", F.col("status").alias("old_status"), new.alias("new_status"),
                    (~F.col("status").eqNullSafe(new)).alias("changed"))


class IssuerStates:
    """States as Parquet under ``path``, partitioned by a bucket of the issuer.

    ``schema``: that of ``day_states``, also where no state is stored yet."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("issuer_id").cast("long")), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, states: DataFrame) -> None:
        # A bucket's rows come from one task, so a bucket is one file.
        (states.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(self.path))

    def create(self, states: DataFrame) -> None:
        """Replace the table by these states."""
        bucketed = states.select("*", self._bucket())
        bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def of(self, issuer_ids: DataFrame) -> DataFrame:
        """The states of these issuers, read from their buckets."""
        return self.read().join(issuer_ids.select("issuer_id", self._bucket()).distinct(), ["bucket", "issuer_id"], "left_semi")

    def merge(self, day: DataFrame) -> DataFrame:
        """Merge a day's states in; returns the new states of its issuers.

        The buckets of the day are read, joined and staged before they replace
        the old ones in one dynamic overwrite; other buckets are not touched.
        A run that is lost before the overwrite has changed nothing, and one
        that is repeated after it merges the same rows again."""
        day = materialize(day.select("*", self._bucket()))
        touched = [r["bucket"] for r in day.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return day.drop("bucket")
        stored = self.read().where(F.col("bucket").isin(*touched))
        new = merge_states(stored, day.drop("bucket")).select("*", self._bucket())
        rest = stored.join(day.select("issuer_id"), "issuer_id", "left_anti")
        staged = materialize(new.withColumn("_new", F.lit(True)).unionByName(rest.withColumn("_new", F.lit(False))))
        self._write(staged.drop("_new"))
        return staged.where("_new").drop("_new", "bucket")
