"""Land fixture rows as JSON documents, shaped like the fetched payloads.

A payload groups rows under a key (calendar month, CIK, ...).  Documents are
built per (key, page) with ``page`` derived from a row id, so one document
never holds more than a page of rows however hot the key: the largest group
collected is bounded by the page size, not by the data.  Some documents land
unreadable, in six ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatline.functions.scalars import normalize_cik
from floatline.session import parallelism


def _by(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the document key before assembling documents.

    Serializing payloads is CPU work on little data, which AQE would
    coalesce into very few tasks; an explicit count keeps it spread (and the
    aggregation then needs no further shuffle)."""
    return rows.repartition(2 * parallelism(rows.sparkSession), *keys)


def ordered_list(value: Column, order: Column, where: Column | None = None) -> Column:
    """Aggregate: ``value`` of the group's rows sorted by ``order``."""
    item = F.struct(order.alias("o"), value.alias("v"))
    if where is not None:
        item = F.when(where, item)
    return F.transform(F.sort_array(F.collect_list(item)), lambda s: s["v"])


def _broken(json: Column, kind: Column) -> Column:
    """A payload that went wrong on its way: cut off, empty, null, a list, an
    error page, or with something behind it."""
    half = F.substring(json, F.lit(1), (F.length(json) / 2).cast("int"))
    kinds = [half, F.lit(""), F.lit("null"), F.concat(F.lit("["), json, F.lit("]")),
             F.lit("<html><body>503 Service Unavailable</body></html>"), F.concat(json, F.lit(" {}"))]
    out = F.when(kind == 0, kinds[0])
    for k, text in enumerate(kinds[1:], start=1):
        out = out.when(kind == k, text)
    return out


# Which landed documents are unreadable (the same rules in SQL are in oracle.py).
def _nasdaq_broken() -> Column:
    return (F.substring("month", 6, 2).cast("int") + F.col("page") * 3) % 5 == 1


def _nyse_broken() -> Column:
    return F.col("page") % 3 == 1


def _submissions_broken() -> Column:
    return (F.col("cik").cast("long") * 7 + F.col("page") * 3) % 61 == 5


def land_nasdaq(rows: DataFrame) -> DataFrame:
    """(month, page, json): ``{"data": {priced, upcoming.upcomingTable, filed,
    withdrawn}}`` with calendar rows; absent fields are left out."""
    item = F.struct(F.col("section"), F.col("dealID"), F.col("companyName"),
                    F.col("proposedTickerSymbol"), F.col("proposedExchange"), F.col("dateText"))
    docs = _by(rows, "month", "page").groupBy("month", "page").agg(ordered_list(item, F.col("row_key")).alias("_rows"))

    def section(name: str, date_key: str) -> Column:
        picked = F.filter("_rows", lambda r: r["section"] == name)
        return F.transform(picked, lambda r: F.struct(
            r["dealID"].alias("dealID"), r["companyName"].alias("companyName"),
            r["proposedTickerSymbol"].alias("proposedTickerSymbol"),
            r["proposedExchange"].alias("proposedExchange"), r["dateText"].alias(date_key)))

    data = F.struct(
        F.struct(section("priced", "pricedDate").alias("rows")).alias("priced"),
        F.struct(F.struct(section("upcoming", "expectedPriceDate").alias("rows")).alias("upcomingTable"))
        .alias("upcoming"),
        F.struct(section("filed", "filedDate").alias("rows")).alias("filed"),
        F.struct(section("withdrawn", "withdrawnDate").alias("rows")).alias("withdrawn"))
    json = F.to_json(F.struct(data.alias("data")))
    return docs.select("month", "page", F.when(_nasdaq_broken(), _broken(json, F.col("page") % 6)).otherwise(json).alias("json"))


def land_nyse(rows: DataFrame) -> DataFrame:
    """(page, json): ``{"calendarList": [...]}``."""
    item = F.struct("issuer_nm", "symbol", "custom_group_exchange_nm", "deal_status_flg",
                    "price_dt", "init_file_dt")
    docs = _by(rows, "page").groupBy("page").agg(ordered_list(item, F.col("row_key")).alias("calendarList"))
    json = F.to_json(F.struct("calendarList"))
    return docs.select("page", F.when(_nyse_broken(), _broken(json, F.col("page") % 6)).otherwise(json).alias("json"))


def land_submissions(rows: DataFrame) -> DataFrame:
    """(cik10, page, json): ``{"cik", "filings": {"recent": {parallel arrays}}}``.

    On every fifth page the primaryDocument array is one short, as a
    truncated payload would be; readers must pad it with null."""
    item = F.struct("accession_no", "form", "filingDate", "primaryDocument")
    docs = _by(rows, "cik", "page").groupBy("cik", "page").agg(ordered_list(item, F.col("row_key")).alias("_rows"))
    col = lambda f: F.transform("_rows", lambda r: r[f])
    short = F.col("page") % 5 == 0
    docs_all = col("primaryDocument")
    primary = F.when(short, F.slice(docs_all, 1, F.size("_rows") - 1)).otherwise(docs_all)
    recent = F.struct(col("accession_no").alias("accessionNumber"), col("form").alias("form"),
                      col("filingDate").alias("filingDate"), primary.alias("primaryDocument"))
    payload = F.struct(F.col("cik"), F.struct(recent.alias("recent")).alias("filings"))
    json = F.to_json(payload)
    return docs.select(normalize_cik("cik").alias("cik10"), "page",
                       F.when(_submissions_broken(), _broken(json, F.col("cik").cast("long") % 6)).otherwise(json).alias("json"))


COMPANY_FIELDS = ["cik", "name", "ticker", "exchange"]


def land_company_list(rows: DataFrame) -> DataFrame:
    """(page, json): ``{"fields": [...], "data": [[...], ...]}``."""
    item = F.array(*[F.col(c).cast("string") for c in COMPANY_FIELDS])
    docs = _by(rows, "page").groupBy("page").agg(ordered_list(item, F.col("row_key")).alias("data"))
    fields = F.array(*[F.lit(c) for c in COMPANY_FIELDS])
    return docs.select("page", F.to_json(F.struct(fields.alias("fields"), F.col("data"))).alias("json"))
