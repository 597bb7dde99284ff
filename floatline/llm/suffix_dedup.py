"""Repeated-window removal by a depth-limited radix sort of suffixes (operator 3).

A window is a string of ``LENGTH`` bytes of one document; it is repeated if it
also starts anywhere else, in the same document included.  Suffixes are
ordered only to that depth, most significant digits first, and equal groups
are the repeated windows.  Sorting every suffix would shuffle many times the
input, so digits are chosen such that suffixes travel in runs:

* Digit 1: every window is keyed by its anchor, the leftmost smallest of the
  hashes of its ``GRAM``-byte substrings.  Equal windows have equal anchors at
  equal offsets, and neighbouring windows share one, so a run of up to 361
  windows is one row (anchor, offsets).  A run whose anchor occurs once in the
  corpus holds no repeated window and ends here.
* A run carries a digest of all its bytes.  Where all runs of an anchor agree,
  the whole group is equal to full depth: every window of it is repeated.  Of
  equal runs beside others, all are repeated and one goes on for comparison.
* Digit 2: what goes on is cut in blocks of 32 offsets, keyed by the bytes that
  all windows of the block share (369 of 400); digests again settle blocks.
* Digit 3: single windows, by the digest of their 400 bytes.

Groups are counted by map-side combined aggregates and joined back, so a group
that holds a third of all rows is never one task's.  Texts move twice, and
only those that are needed: a fixed-size bitmap of wanted keys (4 MB) is
broadcast ahead of these joins.

Defined results: a null text is empty; repeated rows are documents of their
own, so copies of at least 400 bytes go entirely.  Texts of any length
are read in segments.  Extra columns are ignored; an empty table gives an
empty result.  Equality is that of 64-bit digests inside equal 64-bit anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import maybe_in, staged, table
from floatline.llm.vectext import U, batches, running, slice_hash, window_min

LENGTH = 400
GRAM = 40
BLOCK = 32
SEGMENT = 1 << 23
_LOW = U((1 << 24) - 1)
ROW = "uid long, g long, u long, place long"


def _place(p, lo, hi):
    """Anchor position with its first and last window offset, in one number."""
    return (p << 20) | (lo << 10) | hi


def _digest(data: bytes, salt: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, anchor position in the batch, first offset, last offset, anchor hash)
    of the runs of windows of each text that share an anchor."""
    out = [[], [], [], [], []]
    n = len(data)
    for s in range(0, max(1, n), SEGMENT):
        part = data[s:s + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        run = running(part)
        at = np.arange(len(part) - GRAM + 1)
        h = slice_hash(run, at, at + GRAM)
        low = window_min((h & ~_LOW) | at.astype(np.uint64), LENGTH - GRAM + 1)
        anchor = (low & _LOW).astype(np.int64)
        i = np.arange(len(low))
        doc = np.searchsorted(off, i + s, side="right") - 1
        ok = i + s + LENGTH <= off[doc + 1]
        i, anchor, doc = i[ok], anchor[ok], doc[ok]
        if not len(i):
            continue
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        p, first, last = anchor[new], i[new], i[np.r_[new[1:] - 1, len(i) - 1]]
        for column, values in zip(out, (doc[new], p + s, p - last, p - first, h[p])):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every run, and one with the key for every text."""
    from pyspark import TaskContext
    uid0 = TaskContext.get().partitionId() << 38
    for part in parts:
        for first, end, data, off in batches(part.column("text")):
            doc, p, lo, hi, h = runs(data, off)
            raw = data.tobytes()
            u = [_digest(raw[a:b], x) for a, b, x in zip((p - hi).tolist(), (p - lo + LENGTH).tolist(), (lo << 10 | hi).tolist())]
            n = end - first
            uid = uid0 + np.arange(n)
            uid0 += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[uid[doc], uid]), pa.array(np.r_[h.view(np.int64), np.zeros(n, np.int64)]),
                 pa.array(np.r_[np.array(u, np.int64), np.zeros(n, np.int64)]),
                 pa.array(np.r_[_place(p - off[doc], lo, hi), np.zeros(n, np.int64)]),
                 pa.concat_arrays([pa.nulls(len(p), pa.binary()), part.column("key").slice(first, n).cast(pa.binary())])],
                names=["uid", "g", "u", "place", "key"])


def settle(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """(uid, place) of the runs that are repeated as a whole, and one row of
    every distinct run in groups that need a further digit."""
    # Written first: a join with the written counts is shuffled on both sides, so that Spark can split a large group.
    stats = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).where("n > 1"), f"{label}-groups")
    live = staged(maybe_in(rows, "g", stats).join(stats, "g").select("uid", "g", "u", "place", (F.col("low") < F.col("high")).alias("mixed")), label)
    mixed = live.where("mixed")
    kinds = staged(mixed.groupBy("g", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "place")).alias("one")), f"{label}-kinds")
    twice = mixed.join(kinds.where("n > 1").select("g", "u"), ["g", "u"]).select("uid", "place")
    return live.where("NOT mixed").select("uid", "place").union(twice), kinds.select("one.uid", "one.place")


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the requested runs of each text."""
    for pdf in parts:
        for uid, places, text in zip(pdf["uid"], pdf["places"], pdf["text"]):
            raw = text.encode("utf-8")
            place = np.asarray(places, np.int64)
            p, lo, hi = place >> 20, (place >> 10) & 1023, place & 1023
            yield pd.DataFrame({"uid": uid, "place": place,
                                "bytes": [raw[a:b] for a, b in zip(p - hi, p - lo + LENGTH)]})


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut runs in blocks of offsets: keyed by their common bytes, digest of all bytes."""
    for pdf in parts:
        out = []
        for uid, place, raw in zip(pdf["uid"], pdf["place"], pdf["bytes"]):
            p, lo, hi = place >> 20, (place >> 10) & 1023, place & 1023
            # offset o starts at byte hi - o of the run
            for j in range(lo // BLOCK, hi // BLOCK + 1):
                a, b = max(lo, j * BLOCK), min(hi, j * BLOCK + BLOCK - 1)
                # windows of the whole block share these bytes, also where this run has part of the block only
                left = max(0, hi - j * BLOCK)
                common = raw[left:hi - (j * BLOCK + BLOCK - 1) + LENGTH]
                out.append((uid, _digest(common, j), _digest(raw[hi - b:hi - a + LENGTH], a << 10 | b), _place(p, a, b)))
        yield pd.DataFrame(out, columns=["uid", "g", "u", "place"])


def _windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single windows of the requested blocks."""
    for pdf in parts:
        out = []
        for uid, place, places, raw in zip(pdf["uid"], pdf["place"], pdf["places"], pdf["bytes"]):
            p, hi = place >> 20, place & 1023
            for block in places:
                for o in range((block >> 10) & 1023, (block & 1023) + 1):
                    d = hashlib.blake2b(raw[hi - o:hi - o + LENGTH], digest_size=16).digest()
                    out.append((uid, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), _place(p, o, o)))
        yield pd.DataFrame(out, columns=["uid", "g", "u", "place"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(key, ranges) of the texts that hold repeated windows: ``key`` is the
    text's key, ``ranges`` the (start, end) of runs of repeated windows' bytes,
    in no order and overlapping.  ``docs`` has doc_id, key, text."""
    rows = staged(docs.select("key", "text").mapInArrow(_runs, ROW + ", key binary"), "runs")
    texts = rows.where("key IS NOT NULL").select("uid", "key")
    found, ask = settle(rows.where("key IS NULL").drop("key"), "digit1")
    covered = [found]
    # One text stands for all its copies: their windows have been counted above.
    asked = ask.groupBy("uid").agg(F.collect_list("place").alias("places")).join(texts, "uid")
    one = docs.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc"))
    asked = staged(asked.join(one, "key"), "asked")
    near = maybe_in(docs, "key", asked).withColumn("doc", F.coalesce("doc_id", F.lit(0)))
    bytes_ = near.join(asked, ["key", "doc"]).select("uid", "places", "text").mapInPandas(_contexts, "uid long, place long, bytes binary")
    # a row repeated with its doc_id gives its runs again: once is enough
    if one.count() < docs.select("key", "doc_id").distinct().count() or docs.groupBy("key", "doc_id").count().where("count > 1").limit(1).count():
        bytes_ = bytes_.dropDuplicates(["uid", "place"])
    context = staged(bytes_, "contexts")
    found, ask = settle(staged(context.mapInPandas(_blocks, ROW), "blocks"), "digit2")
    covered.append(found)
    ask = ask.withColumn("p", F.shiftright("place", 20))
    want = staged(ask.groupBy("uid", "p").agg(F.collect_list("place").alias("places")), "asked2")
    held = maybe_in(context.withColumn("p", F.shiftright("place", 20)), ["uid", "p"], want)
    inside = held.join(want, ["uid", "p"]).withColumn("places", F.expr(
        "filter(places, x -> ((x >> 10) & 1023) >= ((place >> 10) & 1023) AND (x & 1023) <= (place & 1023))"))
    single = staged(inside.select("uid", "place", "places", "bytes").mapInPandas(_windows, ROW), "digit3")
    twice = staged(single.groupBy("g", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "u"), "digit3-groups")
    covered.append(maybe_in(single, ["g", "u"], twice).join(twice, ["g", "u"]).select("uid", "place"))
    p = F.shiftright("place", 20)
    ranges = reduce(DataFrame.union, covered).groupBy("uid").agg(F.collect_list(F.struct(
        (p - F.col("place").bitwiseAND(1023)).alias("start"),
        (p - F.shiftright("place", 10).bitwiseAND(1023) + LENGTH).alias("end"))).alias("ranges"))
    return staged(ranges.join(texts, "uid").groupBy("key").agg(F.first("ranges").alias("ranges")), "ranges")


def merge_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for key, ranges, text in zip(pdf["key"], pdf["ranges"], pdf["text"]):
            raw, spans = text.encode("utf-8"), merge_ranges(ranges)
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join(kept) + raw[at:]
            rows.append((bytes(key), sum(b - a for a, b in spans), len(spans), kept))
        yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes
    left, if asked for) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sha.alias("sha"))
    base = base.withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    ranges = repeated_runs(base.select("doc_id", "key", "text"))
    cut = maybe_in(base.select("doc_id", "key", "text"), "key", ranges).join(ranges, "key").select("key", "ranges", "text")
    cut = cut.mapInPandas(_remove, "key binary, n_removed long, n_spans long, kept binary")
    cut = cut.withColumn("kept_sha", F.sha2("kept", 256))
    cut = staged((cut if with_bytes else cut.drop("kept")).dropDuplicates(["key"]), "cut")
    narrow = base.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "sha", *(["text"] if with_bytes else []))
    out = narrow.join(cut, "key", "left")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
               F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256")]
    if with_bytes:
        columns.append(F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))
    return out.select(*columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
