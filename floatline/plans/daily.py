"""The daily run: sync, one shared parse of the documents, reports.

J3 and J4 choose their documents differently (is_parsed vs. an existing
lock-up row) but read the same pages.  Here each needed page is converted to
text once, into a materialized text table, and both extractions read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floatline.operators import filings as FL
from floatline.operators import upserts as U
from floatline.plans import jobs as J
from floatline.plans import reports as R
from floatline.session import materialize
from floatline.sinks import csv as K
from floatline.sinks.snapshots import read_latest, write_snapshot

TABLES = ["issuers", "filings", "offerings", "capitalization", "lockups"]
_WORK_COLS = ["issuer_id", "filing_id", "form_type", "filing_date", "primary_doc_url"]


def parse_filings(issuers: DataFrame, filings: DataFrame, documents: DataFrame,
                  offerings: DataFrame, capitalization: DataFrame, lockups: DataFrame,
                  as_of=None, force: bool = False) -> dict:
    """J3 + J4 over one text table.  Returns the new offerings,
    capitalization, lockups and filings, and both jobs' stats."""
    d = R.as_of_col(as_of)
    work_off = materialize(FL.parse_worklist(issuers, filings, documents, force=force))
    work_lk = materialize(FL.parse_worklist(issuers, filings, documents, force=force,
                                            skip_existing=lockups))
    # One row per document to parse, flagged with the job(s) needing it; the
    # flags ride along the text table so each extraction is a narrow filter
    # on it (a join here would shuffle the texts).
    todo = lambda w, off, lk: (w.where(F.col("outcome") == "parse").select(*_WORK_COLS)
                               .withColumn("_off", F.lit(off)).withColumn("_lk", F.lit(lk)))
    needed = (todo(work_off, True, False).unionByName(todo(work_lk, False, True))
              .groupBy(*_WORK_COLS).agg(F.max("_off").alias("_off"), F.max("_lk").alias("_lk"))
              .withColumn("outcome", F.lit("parse")))
    texts = materialize(J.parse_texts(needed, documents, carry=("_off", "_lk")))
    fields = J.LazyTables({
        "off": lambda: materialize(J.offering_fields(texts.where("_off"))),
        "lk": lambda: materialize(J.lockup_fields(texts.where("_lk"))),
    })
    return J.LazyTables({
        "offerings": lambda: U.upsert_offerings(offerings, J.fresh_offerings(fields["off"], issuers), d),
        "capitalization": lambda: U.upsert_capitalization(capitalization, J.fresh_capitalization(fields["off"]), d),
        "lockups": lambda: U.upsert_lockups(lockups, fields["lk"], d, force=force),
        "filings": lambda: FL.mark_parsed(filings, work_off.where(F.col("outcome") == "parse")),
        "offering_stats": FL.run_stats(work_off),
        "lockup_stats": FL.run_stats(work_lk),
    })


def daily_run(tables: dict, documents: DataFrame, submissions: DataFrame | None = None,
              as_of=None, force: bool = False, snapshot_dir: str | None = None,
              export_dir: str | None = None, candidates: tuple[DataFrame | None, ...] = ()) -> dict:
    """J1 (when candidate sources landed) -> J2 (when submissions landed) ->
    J3 + J4 -> J5.

    ``tables``: issuers, filings, offerings, capitalization, lockups.  Every
    table a step changes is written once: as its next version where
    ``snapshot_dir`` is given (and read back from there), else to the
    checkpoint folder.  With ``export_dir`` the three report CSVs are written.
    Returns the new tables, the report frames, the counts of every step and
    J2's failures."""
    t, stats, failures = dict(tables), {}, None

    def settle(name: str, df: DataFrame, final: bool) -> None:
        if not (snapshot_dir and final):
            t[name] = materialize(df)
            return
        path = f"{snapshot_dir.rstrip('/')}/{name}"
        write_snapshot(df, path)
        t[name] = read_latest(df.sparkSession, path)

    if any(c is not None for c in candidates):
        found = J.discover_candidates(t["issuers"], *candidates, as_of=as_of)
        stats["discover"] = found.stats
        settle("issuers", found.tables["issuers"], submissions is None)
    if submissions is not None:
        sync = J.sync_sec_filings(t["issuers"], t["filings"], submissions)
        stats["sync"], failures = sync.stats, sync.tables["failures"]
        settle("filings", sync.tables["filings"], False)
        settle("issuers", sync.tables["issuers"], True)
    elif not stats:
        settle("issuers", t["issuers"], True)
    parsed = parse_filings(t["issuers"], t["filings"], documents, t["offerings"],
                           t["capitalization"], t["lockups"], as_of, force)
    stats |= {"offerings": parsed["offering_stats"], "lockups": parsed["lockup_stats"]}
    for name in ["offerings", "capitalization", "lockups", "filings"]:
        settle(name, parsed[name], True)
    reports = J.export_reports(t, as_of)
    if export_dir:
        K.export(reports, export_dir)
    return {"tables": t, "reports": reports, "stats": stats, "failures": failures}
