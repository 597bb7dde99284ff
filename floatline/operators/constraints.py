"""Table constraints checked as set operations.

Each table is scanned once.  The scan emits, per row, the row checks that
fail (required columns, enumerations) and the keys to compare (primary and
unique keys, foreign keys); keys are then counted (map-side combined) and
joined back, and foreign keys are anti-joined with the primary keys of their
parents, which the same scans emitted.
One output row per violating row: table_name, check_name, row_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.operators.filings import STATUSES, TARGET_FORMS
from floatline.session import materialize

CONFIDENCES = ["high", "medium", "low"]  # FIXED VALUES


def _facts(df: DataFrame, table: str, failed: dict[str, Column], unique: dict[str, list[str]],
           foreign: dict[str, tuple[str, str]]) -> DataFrame:
    """(table_name, kind, check_name, parent, key, row_id) of every row."""
    row = lambda kind, check, parent, key: F.struct(
        F.lit(kind).alias("kind"), F.lit(check).alias("check_name"), F.lit(parent).alias("parent"), key.alias("key"))
    whole = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    facts = [F.when(bad, row("failed", name, None, F.lit(None).cast("string"))) for name, bad in failed.items()]
    facts += [F.when(whole(cols), row("unique", name, None, F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))))
              for name, cols in unique.items()]
    facts += [F.when(F.col(c).isNotNull(), row("foreign", name, parent, F.to_json(F.array(F.col(c).cast("string")))))
              for name, (c, parent) in foreign.items()]
    return df.select(F.lit(table).alias("table_name"), F.col("id").cast("long").alias("row_id"),
                     F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())).alias("f")).select("table_name", "row_id", "f.*")


def _null(*cols: str) -> dict[str, Column]:
    return {f"not_null_{c}": F.col(c).isNull() for c in cols}


def _enum(col: str, values: list[str]) -> dict[str, Column]:
    return {f"enum_{col}": F.col(col).isNotNull() & ~F.col(col).isin(*values)}


def constraint_violations(issuers: DataFrame, filings: DataFrame, offerings: DataFrame,
                          capitalization: DataFrame, lockups: DataFrame) -> DataFrame:
    to_issuer, to_filing = ("issuer_id", "issuers"), ("filing_id", "filings")
    facts = [_facts(issuers, "issuers", _null("company_name") | _enum("status", STATUSES),
                    {"primary_key": ["id"], "unique_cik": ["cik"]}, {}),
             _facts(filings, "filings", _null("issuer_id", "accession_no", "form_type", "filing_date") | _enum("form_type", TARGET_FORMS),
                    {"primary_key": ["id"], "unique_filing": ["issuer_id", "accession_no", "form_type"]}, {"fk_issuer": to_issuer})]
    for name, t in [("offerings", offerings), ("capitalization", capitalization), ("lockups", lockups)]:
        failed = _null("issuer_id") | (_enum("confidence", CONFIDENCES) if name == "lockups" else {})
        facts.append(_facts(t, name, failed, {"primary_key": ["id"]}, {"fk_issuer": to_issuer, "fk_filing": to_filing}))
    found = materialize(reduce(DataFrame.unionByName, facts))
    out = ["table_name", "check_name", "row_id"]
    unique = found.where("kind = 'unique'")
    keys = ["table_name", "check_name", "key"]
    twice = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    primary = unique.where("check_name = 'primary_key'").select(F.col("table_name").alias("parent"), "key").distinct()
    return (found.where("kind = 'failed'").select(*out)
            .unionByName(unique.join(twice, keys, "left_semi").select(*out))
            .unionByName(found.where("kind = 'foreign'").join(primary, ["parent", "key"], "left_anti").select(*out)))
