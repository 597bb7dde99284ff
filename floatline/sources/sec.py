"""Regulatory submissions and documents.

S3 turns landed submissions documents into filing rows, S4 searches a landed
company list, S5 joins filings to landed documents, S6 lists the URLs still
to fetch.  All are DataFrame joins/explodes; fetching itself is outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floatline.functions.scalars import (filing_index_url, filing_primary_doc_url,
                                         normalize_cik, py_strip)
from floatline.operators.filings import TARGET_FORMS
from floatline.operators.partitioning import is_small, join_small
from floatline.operators.ranking import first_per_key
from floatline.session import materialize
from floatline.sources.payloads import UNREADABLE, parsed, quarantine

_SA = T.ArrayType(T.StringType())
SUBMISSIONS_SCHEMA = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("filings", T.StructType([T.StructField("recent", T.StructType([
        T.StructField("accessionNumber", _SA), T.StructField("form", _SA),
        T.StructField("filingDate", _SA), T.StructField("primaryDocument", _SA)]))]))])
COMPANY_LIST_SCHEMA = T.StructType([
    T.StructField("fields", _SA), T.StructField("data", T.ArrayType(_SA))])


def listed_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``submission_rows``, and one row with ``unreadable`` set for
    every document that cannot be read."""
    r = "d.filings.recent"
    z = parsed(docs, SUBMISSIONS_SCHEMA, "cik10", "page").select(
        "cik10", "page", "unreadable", F.coalesce(F.col("d.cik"), F.lit("0")).alias("doc_cik"),
        F.posexplode_outer(F.arrays_zip(
            F.col(f"{r}.accessionNumber").alias("accession_no"),
            F.col(f"{r}.form").alias("form_type"),
            F.col(f"{r}.filingDate").alias("filing_date"),
            F.col(f"{r}.primaryDocument").alias("primary_doc"))).alias("pos", "z"))
    rows = z.where(F.col("unreadable") | F.col("z.form_type").isin(*TARGET_FORMS))
    doc = F.nullif(F.col("z.primary_doc"), F.lit(""))
    return rows.select(
        "cik10", "page", F.col("pos").cast("long").alias("pos"), F.col("z.accession_no").alias("accession_no"),
        F.col("z.form_type").alias("form_type"), F.col("z.filing_date").alias("filing_date"),
        doc.alias("primary_doc"),
        filing_primary_doc_url(F.col("doc_cik"), F.col("z.accession_no"), doc).alias("primary_doc_url"),
        filing_index_url(F.col("doc_cik"), F.col("z.accession_no")).alias("filing_index_url"), "unreadable")


def submission_rows(docs: DataFrame) -> DataFrame:
    """S3 (parse): cik10, page, pos and the filing fields of every listed
    filing of a target form, with URLs.  Short arrays pad with null; an
    unreadable document lists none."""
    return listed_rows(docs).where(~F.col("unreadable")).drop("unreadable")


def unreadable_submissions(docs: DataFrame) -> DataFrame:
    """The submissions documents that cannot be read, as they landed."""
    return quarantine(docs, SUBMISSIONS_SCHEMA, "submissions", "cik10", "page")


def issuer_filings(issuers: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 (per issuer): filing rows of each issuer's landed documents, and
    the issuers that fail, with the ``reason``: ``invalid_cik`` (not an
    integer), ``no_document`` (none landed) or ``unreadable_document``.

    Documents are parsed once; the rows of both outputs are written."""
    keyed = issuers.select(F.col("id").alias("issuer_id"), normalize_cik("cik").alias("cik10"))
    rows = materialize(listed_rows(docs).join(keyed.where(F.col("cik10").isNotNull()), "cik10"))
    broken = rows.where("unreadable").select("issuer_id", "cik10").distinct()
    landed = docs.select("cik10").distinct()
    reason = F.when(F.col("cik10").isNull(), F.lit("invalid_cik")).otherwise(F.lit("no_document"))
    failed = keyed.join(landed, "cik10", "left_anti").select("issuer_id", "cik10", reason.alias("reason"))
    return (rows.where(~F.col("unreadable")).drop("unreadable"),
            failed.unionByName(broken.withColumn("reason", F.lit(UNREADABLE))))


def _grams(col, n: int):
    starts = F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.substring(col, i, n)), lambda g: F.length(g) == n)


def search_companies(companies: DataFrame, queries: DataFrame, max_results: int = 10) -> DataFrame:
    """Per query, companies whose name contains it or whose ticker equals
    it (case-insensitive), the first ``max_results`` in list order.

    ``companies``: page, pos, cik, name, ticker, exchange.
    ``queries``: query_id, query.  An exact substring match by equi-joins on
    character n-grams, whatever the number of queries:

    * a query of one or two letters is its own gram and needs the gram's first
      ``max_results`` companies only;
    * a longer one joins on its rarest trigram, the names are verified, and its
      first ``max_results`` companies are kept;
    * both cuts are made in the map tasks, so shuffled rows are at most that many
      a query (a gram) and task;
    * an empty query matches every name: the first ``max_results`` companies.

    The list is parsed and written once; only (gram, company, lower-case name) travels; the other columns join the
    at most ``max_results`` rows of each query at the end.  The queries go to every task while they have few grams,
    else both sides are shuffled: the names' grams never go through the driver."""
    q = queries.select("query_id", F.lower(py_strip(F.coalesce("query", F.lit("")))).alias("q"))
    companies = materialize(companies.select("page", "pos", "cik", "name", "ticker", "exchange"))
    c = companies.select("page", "pos", F.lower(F.coalesce("name", F.lit(""))).alias("_name"),
                         F.lower(F.coalesce("ticker", F.lit(""))).alias("_ticker"))
    filled = q.where(F.length("q") > 0)
    wanted = filled.select("query_id", "q", F.explode(F.when(F.length("q") >= 3, _grams(F.col("q"), 3))
                                                      .otherwise(F.array(F.col("q")))).alias("_g"))
    small = is_small(wanted)  # and so are the tables with at most a row a query or gram
    grams = lambda *sizes: c.select("page", "pos", "_name", F.explode(F.array_distinct(F.concat(
        *[_grams(F.col("_name"), n) for n in sizes]))).alias("_g"))
    # Each branch keeps the first companies of a query (of a gram): Spark cuts
    # them in the map tasks, so that a gram all names share is not shuffled.
    first = lambda rows, by: rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy(by).orderBy("page", "pos"))).where(F.col("_n") <= max_results).drop("_n")
    asked = filled.where(F.length("q") < 3)
    short = first(join_small(grams(1, 2), asked.select(F.col("q").alias("_g")).distinct(), small, "_g", "left_semi"), "_g")
    short = join_small(short, asked.withColumnRenamed("q", "_g"), small, "_g").select("query_id", "page", "pos")
    long_grams = wanted.where(F.length("q") >= 3)
    freq = join_small(grams(3), long_grams.select("_g").distinct(), small, "_g", "left_semi") \
        .groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    rarest = first_per_key(join_small(freq, long_grams, small, "_g"), ["query_id"], [F.col("_df"), F.col("_g")])
    long = first(join_small(grams(3), rarest.select("query_id", "q", "_g"), small, "_g")
                 .where(F.col("_name").contains(F.col("q"))).select("query_id", "page", "pos"), "query_id")
    ticker = first(join_small(c, filled, small, F.col("_ticker") == F.col("q")).select("query_id", "page", "pos"), "query_id")
    # The first companies in list order: a distributed top-k (limit is the feature here).
    top = c.select("page", "pos").orderBy("page", "pos").limit(max_results)
    slots = top.withColumn("_slot", F.row_number().over(Window.orderBy("page", "pos")) - 1)
    empty = (q.where(F.length("q") == 0).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(max_results - 1))))
             .join(F.broadcast(slots), "_slot").select("query_id", "page", "pos"))  # max_results rows by construction
    hits = short.union(long).union(ticker).union(empty).distinct()
    order = Window.partitionBy("query_id").orderBy("page", "pos")
    best = hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max_results)
    rows = best.join(companies.hint("merge"), ["page", "pos"])
    # a row without a CIK field reads as CIK 0
    return rows.select("query_id", "rank", normalize_cik(F.coalesce("cik", F.lit("0"))).alias("cik"),
                       "name", "ticker", "exchange")


def company_list_rows(docs: DataFrame) -> DataFrame:
    """S4 (parse): page, pos and the named fields of each company row."""
    d = parsed(docs, COMPANY_LIST_SCHEMA, "page")
    e = d.select("page", F.col("d.fields").alias("fields"), F.posexplode("d.data").alias("pos", "row"))
    n = F.least(F.size("fields"), F.size("row"))
    m = F.map_from_arrays(F.slice("fields", 1, n), F.slice("row", 1, n))
    return e.select("page", "pos", *[m.getItem(k).alias(k) for k in ["cik", "name", "ticker", "exchange"]])


def document_join(best: DataFrame, documents: DataFrame, columns: tuple[str, ...] = ("html",)) -> DataFrame:
    """Best filings with their landed document (null if absent).  Only
    the requested document columns are read (e.g. ``n_chars`` alone never
    touches the pages)."""
    d = documents.select(F.col("url").alias("_doc_url"), *columns)
    # Filings without a URL cannot match; kept out of the join they do not meet on one key.
    found = best.where(F.col("primary_doc_url").isNotNull()).join(d, F.col("primary_doc_url") == F.col("_doc_url"), "left")
    none = best.where(F.col("primary_doc_url").isNull())
    return found.unionByName(none, allowMissingColumns=True).withColumn(
        "has_document", F.col("_doc_url").isNotNull()).drop("_doc_url")


def fetch_worklist(needed: DataFrame, documents: DataFrame) -> DataFrame:
    """URLs needed and not landed, with their cache key (24 hex digits
    of SHA-256)."""
    u = needed.select(F.col("primary_doc_url").alias("url")).where(F.col("url").isNotNull()).distinct()
    todo = u.join(documents.select("url"), "url", "left_anti")
    return todo.select("url", F.substring(F.sha2(F.col("url"), 256), 1, 24).alias("cache_key"))
