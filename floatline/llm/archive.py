"""WARC records in ZIP packages: writer and range reader (operator 8).

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``
(one line a record, with its offset and length in the archive).  The reader
never extracts: it reads the end of the file, the central directory (ZIP64
included), the index, and then the byte ranges of the records.

Writing and reading are Spark jobs.  Every task writes packages of bounded
size; only those of committed tasks are listed, so a lost executor leaves at
most files that nobody reads.  Reading lists records from the indexes, deals
them out by package and range, and each task fetches neighbouring ranges
together.  Files are opened through pyarrow's file systems, so packages may lie
wherever those reach (a shared folder, an object store, HDFS).

Equal payloads: the record with the largest page_id is the response, the
others are revisits of it; payloads shorter than ``min_bytes`` are all
responses.  Defined results: null html is the empty payload; a null page_id
comes last; of rows that repeat page_id and payload, one is the response.
Extra columns are ignored, an empty table gives an empty result.  Payloads
are read whole, one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatline.llm.common import shared_path, staged, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
FETCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(path: str):
    """(file system, path inside it) for a URI or a plain path."""
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records

def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: the full response, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}",
            f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or 'about:blank', safe=SAFE)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(map(chr, range(0x21, 0x7F)))


def record_id(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload without its HTTP headers) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- packages

class _Forward(io.RawIOBase):
    """Output that zipfile only appends to."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


class PackageWriter:
    """One package, written front to back."""

    def __init__(self, files, path: str):
        self.raw = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Forward(self.raw), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, record: bytes, entry: dict) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({**entry, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.raw.close()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def read_directory(source, size: int) -> list[Member]:
    """Members from the central directory of a ZIP file, ZIP64 or not.
    ``source`` has read_at(bytes, offset)."""
    tail_at = max(0, size - (22 + 0xFFFF))
    tail = source.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail[at - 20:at] if at >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        end64 = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    raw, at, out = source.read_at(length, start), 0, []
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain = struct.unpack_from("<II", raw, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", raw, at + 28)
        header, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + n_name].decode("utf-8")
        extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 8-byte values of the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_note
    return out


def member_start(source, member: Member) -> int:
    """Offset of a stored member's bytes."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def gzip_members(source, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a range, read in blocks: for packages without an index."""
    at, begun, unzip, pending = 0, 0, zlib.decompressobj(31), b""
    while at < size or pending:
        if not pending:
            pending = source.read_at(min(FETCH_BYTES, size - at), start + at)
            at += len(pending)
        unzip.decompress(pending)
        pending = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            end = at - len(pending)
            yield begun, end - begun
            begun, unzip = end, zlib.decompressobj(31)


# ---------------------------------------------------------------- Spark jobs

def _write(folder: str, package_bytes: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get()
        files, base = open_folder(folder)
        files.create_dir(base)
        writer, done, n = None, [], 0
        for pdf in parts:
            for page_id, url, payload, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.wacz"
                    writer, n = PackageWriter(files, f"{base}/{name}"), 0
                payload = bytes(payload)
                digest = payload_digest(payload)
                writer.add(warc_record(page_id, url, payload, digest, refers_to), {"id": record_id(page_id), "digest": digest})
                n += 1
                if writer.size >= package_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", n))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{name}", n))
        yield pd.DataFrame(done, columns=["path", "records"])
    return run


def revisit_plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with refers_to: the record id of the
    response that a revisit points to, null for responses."""
    keyed = pages.withColumn("sha", F.sha1("payload"))
    narrow = keyed.select("page_id", "sha").where(F.octet_length("payload") >= min_bytes)
    groups = narrow.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = keyed.join(groups.select("sha", "keep", F.lit(True).alias("grouped")), "sha", "left")
    target = F.concat(F.lit("urn:page:"), F.coalesce(F.col("keep").cast("string"), F.lit("")))
    revisit = F.col("grouped") & ~F.col("page_id").eqNullSafe(F.col("keep"))
    out = joined.withColumn("refers_to", F.when(revisit, target))
    repeated = narrow.groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.limit(1).count():
        return out.select("page_id", "url", "payload", "refers_to")
    # rows that repeat page_id and payload: all but one of the responses revisit it
    again = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url"))
    out = out.withColumn("again", F.when(F.col("grouped") & F.col("refers_to").isNull(), again))
    return out.select("page_id", "url", "payload", F.when(F.col("again") > 1, target).otherwise(F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0,
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages; returns (path, records) of each."""
    folder = folder or shared_path(pages.sparkSession, "packages")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return staged(revisit_plan(pages, min_bytes).mapInPandas(_write(folder, package_bytes), "path string, records long"), "manifest")


def _list(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of every package, as ranges of the package file."""
    for pdf in parts:
        for path in pdf["path"]:
            files, inner = open_folder(path)
            with files.open_input_file(inner) as source:
                members = {m.name: m for m in read_directory(source, source.size())}
                start = member_start(source, members[DATA])
                if INDEX in members:
                    raw = source.read_at(members[INDEX].size, member_start(source, members[INDEX]))
                    spans = [(e["offset"], e["length"]) for e in map(json.loads, raw.decode("utf-8").splitlines())]
                else:
                    spans = list(gzip_members(source, start, members[DATA].size))
            yield pd.DataFrame({"path": path, "offset": [start + a for a, _ in spans], "length": [n for _, n in spans]})


def _fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read records by range; neighbours within FETCH_BYTES share one read."""
    for pdf in parts:
        for path, part in pdf.groupby("path", sort=False):
            files, inner = open_folder(path)
            spans = sorted(zip(part["offset"], part["length"]))
            with files.open_input_file(inner) as source:
                k = 0
                while k < len(spans):
                    begin, end, last = spans[k][0], sum(spans[k]), k + 1
                    while last < len(spans) and sum(spans[last]) - begin <= FETCH_BYTES:
                        end = max(end, sum(spans[last]))
                        last += 1
                    raw, rows = source.read_at(end - begin, begin), []
                    for at, n in spans[k:last]:
                        fields, payload = parse_record(gzip.decompress(raw[at - begin:at - begin + n]))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                        rows.append((fields["warc-record-id"].strip("<>"), fields["warc-type"], fields["warc-target-uri"], digest,
                                     fields.get("warc-refers-to", "").strip("<>") or None, None if revisit else payload))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                    k = last


RECORD = "record_id string, record_type string, url string, payload_digest string, refers_to string, payload binary"


def read_archives(packages: DataFrame) -> DataFrame:
    """Every record of the packages (path): see RECORD; revisits have no payload."""
    spark = packages.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spans = packages.select("path").repartition(n, "path").mapInPandas(_list, "path string, offset long, length long")
    block = F.floor(F.col("offset") / FETCH_BYTES)
    dealt = spans.withColumn("block", block).repartition(n, "path", "block").sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "length").mapInPandas(_fetch, RECORD)


def page_records(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to packages, read them back: a row per page."""
    read = read_archives(write_archives(pages, folder, min_bytes))
    page = lambda c: F.nullif(F.substring(c, len("urn:page:") + 1, 1 << 30), F.lit("")).cast("long")
    rows = staged(read.select(page(F.col("record_id")).alias("page_id"), "payload_digest", "record_type",
                              page(F.col("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("n")), "records")
    # a revisit's payload is that of the response with its digest
    known = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("n").alias("known"))
    return rows.join(known, "payload_digest").select(
        "page_id", F.coalesce("n", "known").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha,
         max(page_id) OVER (PARTITION BY sha1(html)) AS keep FROM p),
n AS (
  SELECT *, concat('0x', substr(sha, 1, 10))::UBIGINT AS a, concat('0x', substr(sha, 11, 10))::UBIGINT AS b,
         concat('0x', substr(sha, 21, 10))::UBIGINT AS c, concat('0x', substr(sha, 31, 10))::UBIGINT AS e FROM d)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               1 + (([a, b, c, e][1 + i // 8] // (32 ** (7 - i % 8))::UBIGINT) % 32)::INTEGER, 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM n
"""
