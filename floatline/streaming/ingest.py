"""Incremental filing ingest with Structured Streaming and keyed state.

New landed submissions files are read with ``readStream``, parsed (S3) and
grouped by slots, each of which takes some ``SLOT`` CIKs by hash.  What the sync
has to know about an issuer lives in the stream's state: its id, its status,
and the stored filing keys.  The issuers of a slot are one entry, so that a batch
asks the state once a slot, not several times an issuer.  The tables are read once, as the state's first content; from then on a batch reads
the files that landed and the state entries of their issuers' slots, however large
the tables have grown.  The state survives restarts with the checkpoint.

A batch's outcome (new filings, status changes, unreadable documents) is
written to a folder of its own before anything else is done with it, and ids
go on from the end noted by the batches before.  A batch that runs again after
a failure overwrites its folders, and looks once at the table for the rows its
first attempt may have appended.
"""

from __future__ import annotations

import json
import zlib
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from floatline.functions.scalars import normalize_cik
from floatline.operators.filings import FILING_FORMS, NO_DOWNGRADE, apply_status, number_filings
from floatline.operators.ranking import max_id
from floatline.sources import sec
from floatline.sources.payloads import UNREADABLE

LANDED_SCHEMA = T.StructType([
    T.StructField("cik10", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("json", T.StringType()),
])
OUTCOME = ("kind string, cik10 string, issuer_id long, page long, pos long, accession_no string, form_type string, "
           "filing_date string, primary_doc_url string, filing_index_url string, old_status string, new_status string")
NEAR_BY = 256  # filing keys kept in one entry with the issuer
SLOT = 64  # issuers in one entry
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _processor() -> StatefulProcessor:
    """The state of one slot of CIKs and what a batch's rows do to it.

    Defined in here, so that it travels to the workers by value and they need
    no copy of this package."""
    import pandas as pd

    fields, near_by = [c.split()[0] for c in OUTCOME.split(", ")], NEAR_BY
    filing_forms, no_downgrade = set(FILING_FORMS), set(NO_DOWNGRADE)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=fields, dtype=object)
        for c in ("issuer_id", "page", "pos"):
            out[c] = out[c].astype("Int64")
        return out

    def outcome(kind: str, **values) -> list:
        return [kind] + [values.get(f) for f in fields[1:]]

    class FilingState(StatefulProcessor):
        """The issuers of a slot by CIK: [id, status, first filing keys, whether there are more].
        One entry to fetch for most batches; the keys beyond have an entry each."""

        def init(self, handle) -> None:
            self.slot = handle.getValueState("slot", "issuers binary")
            self.others = handle.getMapState("others", "key string", "stored boolean")

        def read(self) -> dict:
            held = self.slot.get()
            return json.loads(zlib.decompress(bytes(held[0]))) if held else {}

        def write(self, issuers: dict) -> None:
            self.slot.update((zlib.compress(json.dumps(issuers).encode(), 1),))

        def handleInitialState(self, key, pdf, timers) -> None:
            issuers = self.read()
            for cik10, issuer_id, status, new in zip(pdf["cik10"], pdf["issuer_id"], pdf["status"], pdf["keys"]):
                held = issuers.get(cik10, [None, None, [], False])
                more = self.add(cik10, held[2], [] if new is None else list(new))
                issuers[cik10] = [int(issuer_id), None if pd.isna(status) else status, held[2], held[3] or more]
            self.write(issuers)

        def add(self, cik10: str, keys: list, new: list) -> bool:
            """Whether some had to go to entries of their own."""
            room = max(0, near_by - len(keys))
            keys.extend(new[:room])
            for k in new[room:]:
                self.others.updateValue((f"{cik10} {k}",), (True,))
            return len(new) > room

        def handleInputRows(self, key, rows, timers):
            issuers, by_cik, out = self.read(), {}, []
            for pdf in rows:
                pdf = pdf.astype(object).where(pdf.notna(), None)
                for r in pdf.itertuples(index=False):
                    by_cik.setdefault(r.cik10, []).append(r)
            changed = False
            for cik10, found in by_cik.items():
                changed |= self.one(cik10, found, issuers, out)
            if changed:
                self.write(issuers)
            yield frame(out)

        def one(self, cik10, found: list, issuers: dict, out: list) -> bool:
            held = issuers.get(cik10)
            if held is None:
                out.append(outcome("unknown_issuer", cik10=cik10))
                return False
            issuer_id, status, keys, more = held
            known, added = set(keys), []
            for page in sorted({r.page for r in found if r.unreadable}):
                out.append(outcome("unreadable", cik10=cik10, issuer_id=issuer_id, page=page))
            found = [r for r in found if not r.unreadable]
            valid = [r for r in found if r.accession_no and r.form_type]
            # latest date first, then the documents' order: of a key listed twice the first counts
            valid.sort(key=lambda r: (r.page, r.pos))
            valid.sort(key=lambda r: r.filing_date or "", reverse=True)
            for r in valid:
                k = f"{r.form_type} {r.accession_no}"
                if k not in known and not (more and self.others.containsKey((f"{cik10} {k}",))):
                    known.add(k)
                    added.append(k)
                    out.append(outcome("filing", cik10=cik10, issuer_id=issuer_id, page=r.page, pos=r.pos,
                                       accession_no=r.accession_no, form_type=r.form_type, filing_date=r.filing_date,
                                       primary_doc_url=r.primary_doc_url, filing_index_url=r.filing_index_url))
            now = status
            if found:
                now = status or "candidate"
                forms = {r.form_type for r in valid}
                if "RW" in forms:
                    now = "withdrawn"
                elif now not in no_downgrade and now != "withdrawn" and forms & filing_forms:
                    now = "filed"
                out.append(outcome("status", cik10=cik10, issuer_id=issuer_id, old_status=status, new_status=now))
            if not added and now == status:
                return False
            more |= self.add(cik10, keys, added)
            issuers[cik10] = [issuer_id, now, keys, more]
            return True

        def close(self) -> None:
            pass

    return FilingState()


def _first_state(issuers: DataFrame, filings: DataFrame) -> DataFrame:
    """(cik10, issuer_id, status, keys): the issuers with a CIK and their stored
    filing keys, in lists of about ``NEAR_BY``: an issuer with more has several rows."""
    keyed = issuers.where("cik is not null").select(normalize_cik("cik").alias("cik10"), F.col("id").alias("issuer_id"), "status")
    stored = filings.where("accession_no is not null and form_type is not null").select(
        "issuer_id", F.concat_ws(" ", "form_type", "accession_no").alias("key"))
    counts = stored.groupBy("issuer_id").agg(F.ceil(F.count(F.lit(1)) / NEAR_BY).alias("lists"))
    lists = (stored.join(counts, "issuer_id").groupBy("issuer_id", F.pmod(F.xxhash64("key"), F.col("lists")).alias("list"))
             .agg(F.collect_list("key").alias("keys")))
    return keyed.where("cik10 is not null").join(lists, "issuer_id", "left").select("cik10", "issuer_id", "status", "keys")


def _slots(spark: SparkSession, issuers: DataFrame, checkpoint_dir: str) -> int:
    """How many slots the CIKs are dealt to: fixed by a checkpoint's first batch."""
    path = f"{checkpoint_dir.rstrip('/')}-batches/slots"
    kept = _read(spark, path)
    if kept is None:
        n = max(1, -(-issuers.count() // SLOT))
        spark.createDataFrame([(n,)], "slots long").write.mode("overwrite").parquet(path)
        return n
    return kept.first()[0]


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("cik10"), F.lit(slots)).alias("slot")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written there yet
        return None


@contextmanager
def _state_store(spark: SparkSession, partitions: int | None):
    """Keyed state needs the RocksDB store, which keeps it on disk beside each task."""
    wanted = {_PROVIDER: _ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def current_issuers(spark: SparkSession, issuers: DataFrame, transitions_dir: str) -> DataFrame:
    """``issuers`` with the status that the batches left."""
    log = _read(spark, transitions_dir)
    if log is None:
        return issuers
    last = log.groupBy("issuer_id").agg(F.max_by("new_status", "batch").alias("new_status")).withColumn("changed", F.lit(True))
    return apply_status(issuers, last)


def ingest_filings(spark: SparkSession, landing_dir: str, filings_dir: str, checkpoint_dir: str,
                   issuers: DataFrame, files_per_batch: int = 1, transitions_dir: str | None = None,
                   failures_dir: str | None = None, state_partitions: int | None = None) -> None:
    """Process every landed submissions file not yet seen: append new filings
    (D5) to the parquet table at ``filings_dir`` (which must exist); write each
    batch's status changes (D8) to ``transitions_dir`` and its failed documents
    to ``failures_dir`` where given, a folder per batch.  ``trigger(availableNow)``
    processes what has landed and stops.

    ``issuers`` and the table are read by a checkpoint's first batch only.  A
    document of a CIK unknown then is listed among the failures with the reason
    ``unknown_issuer``; a new checkpoint takes new issuers up.  The state is
    spread over ``state_partitions`` (by default the shuffle partitions) for as
    long as the checkpoint lives; each costs a Python worker a batch."""
    batches = f"{checkpoint_dir.rstrip('/')}-batches"

    def batch(outcomes: DataFrame, batch_id: int) -> None:
        again = _read(spark, f"{batches}/outcomes/batch={batch_id}") is not None
        outcomes.write.mode("overwrite").parquet(f"{batches}/outcomes/batch={batch_id}")
        done = spark.read.schema(outcomes.schema).parquet(f"{batches}/outcomes/batch={batch_id}")
        if transitions_dir:
            changed = (~F.col("old_status").eqNullSafe(F.col("new_status"))).alias("changed")
            done.where("kind = 'status'").select("issuer_id", "old_status", "new_status", changed) \
                .write.mode("overwrite").parquet(f"{transitions_dir}/batch={batch_id}")
        if failures_dir:
            reason = F.when(F.col("kind") == "unreadable", F.lit(UNREADABLE)).otherwise(F.col("kind"))
            done.where("kind in ('unreadable', 'unknown_issuer')").select("issuer_id", "cik10", "page", reason.alias("reason")) \
                .write.mode("overwrite").parquet(f"{failures_dir}/batch={batch_id}")
        ends = _read(spark, f"{batches}/ends")
        start = ends.where(F.col("batch") < batch_id).agg(F.max("last_id")).first()[0] if ends is not None else None
        if start is None:
            start = max_id(spark.read.parquet(filings_dir))
            spark.createDataFrame([(start,)], "last_id long").write.mode("overwrite").parquet(f"{batches}/ends/batch=-1")
        new = done.where("kind = 'filing'")
        numbered = number_filings(new, start)
        if again:
            key = ["issuer_id", "accession_no", "form_type"]
            numbered = numbered.join(spark.read.parquet(filings_dir).select(*key), key, "left_anti").select(*numbered.columns)
        numbered.write.mode("append").parquet(filings_dir)
        end = start + new.count()
        spark.createDataFrame([(end,)], "last_id long").write.mode("overwrite").parquet(f"{batches}/ends/batch={batch_id}")

    landed = (spark.readStream.schema(LANDED_SCHEMA)
              .option("maxFilesPerTrigger", files_per_batch).parquet(landing_dir))
    rows = sec.listed_rows(landed).drop("primary_doc")
    slots = _slots(spark, issuers, checkpoint_dir)
    with _state_store(spark, state_partitions):
        first = _first_state(issuers, spark.read.parquet(filings_dir))
        outcomes = rows.select("*", _slot(slots)).groupBy("slot").transformWithStateInPandas(
            _processor(), OUTCOME, "Append", "None",
            initialState=first.select("*", _slot(slots)).groupBy("slot"))
        q = (outcomes.writeStream.foreachBatch(batch).outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", checkpoint_dir).start())
        q.awaitTermination()
