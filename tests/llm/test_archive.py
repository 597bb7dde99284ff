"""Operator 8: exact round trips, ZIP64, and the query against brute force."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from floatline.llm import archive

SF = "/root/testdata/sf0.001"
LAYOUT = "page_id long, url string, html string, payload string, n int, keep string"


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        assert 0 <= at and at + n <= len(self.data)
        return self.data[at:at + n]


def rows():
    return [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/ü\r\nX: y", None), (4, "http://c/", ""),
            (5, "http://d/", "é" * 70000), (6, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://f/", "<p>x</p>"),
            (7, "http://g/", "<p>x</p>"), (8, "u", "same"), (8, "u", "same"), (None, "u", "same"), (None, "u", "only")]


def frame(spark, data):
    return spark.createDataFrame([(p, u, h, "clash", 1, "c") for p, u, h in data], LAYOUT)


def test_query_columns_against_brute_force(spark):
    got = archive.page_records(frame(spark, rows())).collect()
    assert len(got) == len(rows())
    groups = {}
    for p, _, h in rows():
        groups.setdefault(h or "", []).append(p)
    for html, ids in groups.items():
        digest = archive.payload_digest(html.encode())
        mine = [r for r in got if r["payload_digest"] == digest]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r["page_id"]) for r in mine)
        assert {r["payload_bytes"] for r in mine} == {len(html.encode())}
        assert [r["page_id"] for r in mine if r["record_type"] == "response"] == [keep]
        assert all(r["refers_to"] == (None if r["record_type"] == "response" else keep) for r in mine)


def test_small_payloads_are_all_responses(spark):
    got = archive.page_records(frame(spark, rows()), min_bytes=6).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 6)
    assert sum(r["record_type"] == "revisit" for r in got) == 3


def test_round_trip_over_many_packages(spark):
    data = [(i, f"http://x/{i}", f"<html>{i} é</html>" * (i % 50)) for i in range(200)]
    packages = archive.write_archives(frame(spark, data), package_bytes=400)
    assert packages.count() > 20 and packages.agg(F.sum("records")).first()[0] == 200
    read = {r["record_id"]: r for r in archive.read_archives(packages).collect()}
    for i, url, html in data:
        r = read[archive.record_id(i)]
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html.encode() and r["url"] == url
        else:
            other = read[r["refers_to"]]
            assert other["record_type"] == "response" and bytes(other["payload"]) == html.encode()
    for p in packages.collect():  # another reader accepts the packages
        with zipfile.ZipFile(p["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"note PK\x05\x06 inside"
        for name in ("a", "dir/b"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(name.encode() * 10)
    plain = out.getvalue()
    members = archive.read_directory(Bytes(plain), len(plain))
    assert [m.name for m in members] == ["a", "dir/b"]
    for m in members:
        start = archive.member_start(Bytes(plain), m)
        assert plain[start:start + m.size] == m.name.encode() * 10


def test_zip64_end_records_and_fields(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(8):
            z.writestr(f"m{i}", bytes([i]) * (50 + 20 * i))
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    members = archive.read_directory(Bytes(data), len(data))
    assert [(m.name, m.size) for m in members] == [(f"m{i}", 50 + 20 * i) for i in range(8)]
    for i, m in enumerate(members):
        start = archive.member_start(Bytes(data), m)
        assert data[start:start + m.size] == bytes([i]) * m.size


def test_broken_files_and_compressed_members():
    with pytest.raises(ValueError):
        archive.read_directory(Bytes(b"x" * 100), 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "aaaa" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError):
        archive.member_start(Bytes(data), archive.read_directory(Bytes(data), len(data))[0])


def test_package_without_index(monkeypatch):
    import gzip
    monkeypatch.setattr(archive, "FETCH_BYTES", 64)
    packed = [gzip.compress(bytes([i]) * 3000 + str(i).encode() * 40, mtime=0) for i in range(6)]
    source = Bytes(b"head" + b"".join(packed))
    spans = list(archive.gzip_members(source, 4, sum(map(len, packed))))
    assert [n for _, n in spans] == [len(p) for p in packed]
    assert [source.data[4 + a:4 + a + n] for a, n in spans] == packed


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"select {columns} from ({archive.OP8_SQL}) order by 1").fetchall()
    got = archive.op8_zip_warc(spark, SF).selectExpr(*columns.split(", ")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want


def test_empty_table(spark):
    assert archive.page_records(frame(spark, [])).count() == 0


def test_index_lines_are_json(spark):
    packages = archive.write_archives(frame(spark, rows()))
    path = packages.first()["path"].removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        entries = [json.loads(x) for x in z.read(archive.INDEX).decode().splitlines()]
    assert {"id", "digest", "offset", "length"} <= set(entries[0])
