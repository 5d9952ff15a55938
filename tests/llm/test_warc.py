"""Web archives: written ones read by a plain sequential parser, foreign ones, awkward payloads."""

import base64
import glob
import gzip
import hashlib
import re
from collections import Counter

from vetta.llm import warc

SCHEMA = "page_id long, url string, html string, uid long, sha string, digest string, `first` long"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", 2) for i, u, h in rows], SCHEMA)


def sequential(path):
    """All records of all files: (header dict, concurrent-to list, block), by declared lengths."""
    out = []
    for name in glob.glob(f"{path}/part-*"):
        data = gzip.open(name).read() if name.endswith(".gz") else open(name, "rb").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            out.append((fields, rest[:n]))
            data = rest[n + 4:]
    return out


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    out, groups = [], {}
    for i, u, h in rows:
        groups.setdefault(h or "", []).append(i)
    for h, ids in groups.items():
        data = h.encode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = k < len(ids) - 1 and len(data) >= least
            out.append((i, len(data), b32(data), "revisit" if again else "response", ids[-1] if again else None))
    return Counter(out)


def round_trip(spark, rows, path, **options):
    warc.write_warc(frame(spark, rows), path, **options)
    found = warc.with_page_ids(warc.captures(spark, path, with_payload=True)).collect()
    return found, Counter((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.found_digest or r.payload_digest, r.type,
                           None if r.refers_to_page is None else int(r.refers_to_page)) for r in found)


ROWS = [(1, "http://a.example/x?q=1#f", "<p>Über</p>"), (2, "http://b.example", "<p>Über</p>"), (3, None, None), (4, "http://c/ d\r\ne", ""),
        (5, "http://a.example/y", "one\r\n\r\ntwo\n"), (5, "http://a.example/y", "one\r\n\r\ntwo\n"), (None, "http://n/", "null id"),
        (-7, "http://neg/", "x" * 3000000), (8, "http://m/", "x" * 3000000), (9, "u", "\r\n\r\n"), (10, "http://z/", "\x00\x1f")]


def test_round_trip(spark, tmp_path):
    found, got = round_trip(spark, ROWS, f"{tmp_path}/a")
    assert got == expected(ROWS)
    by_id = {r.page_id: r for r in found if r.type == "response"}
    for r in found:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        assert (r.payload is None) == (r.type == "revisit")
        assert r.found_digest in (None, r.payload_digest)
    assert bytes(by_id["8"].payload) == b"x" * 3000000
    assert by_id["2"].requests[0].http_head.startswith("GET / HTTP/1.1\r\nHost: b.example")
    assert [r.target_uri for r in found if r.page_id == "4"] == ["http://c/%20d%0D%0Ae"]
    _, got = round_trip(spark, ROWS, f"{tmp_path}/b", least=5)
    assert got == expected(ROWS, 5)


def test_archives_follow_the_format(spark, tmp_path):
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write_warc(frame(spark, ROWS).repartition(3), path, compression=compression)
        records = sequential(path)
        assert Counter(f["WARC-Type"] for f, _ in records) == {"request": 11, "metadata": 11, "response": 7, "revisit": 4}
        ids = {f["WARC-Record-ID"]: (f, b) for f, b in records}
        assert len(ids) == 33 and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
        for f, block in records:
            if f["WARC-Type"] in ("request", "metadata"):
                assert ids[f["WARC-Concurrent-To"]][0]["WARC-Type"] in ("response", "revisit")
            elif f["WARC-Type"] == "revisit":
                assert ids[f["WARC-Refers-To"]][0]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
                assert block.endswith(b"\r\n\r\n") and b"Content-Length: " in block
            else:
                assert f["WARC-Payload-Digest"] == "sha1:" + b32(block.partition(b"\r\n\r\n")[2])


def test_payloads_that_hold_records(spark, tmp_path):
    rows = [(1, "http://a/WARC/1.1", FAKE), (2, "http://b/", "about WARC/1. and WARC/1.WARC/1."), (3, "http://c/", "plain"), (4, "http://d/", FAKE * 3),
            (5, "WARC/1.", "WARC/1.0\r\n"), (6, "http://e/", FAKE)]
    for compression in ("gzip", "none"):
        found, got = round_trip(spark, rows, f"{tmp_path}/{compression}", compression=compression)
        assert got == expected(rows)
        assert {r.page_id: bytes(r.payload).decode() for r in found if r.type == "response"} == {str(i): h for i, _, h in rows if i != 1}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")        # files in many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.with_page_ids(warc.captures(spark, f"{tmp_path}/none")).collect()
        assert sorted(r.page_id for r in found) == list("123456")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_binary_payloads(spark, tmp_path):
    data = bytes(range(256)) * 5
    pages = spark.createDataFrame([(1, "http://a/", bytearray(data)), (2, "http://b/", bytearray(data)), (3, "http://c/", None)],
                                  "page_id long, url string, html binary")
    warc.write_warc(pages, f"{tmp_path}/a")
    found = {r.page_id: r for r in warc.with_page_ids(warc.captures(spark, f"{tmp_path}/a", with_payload=True)).collect()}
    assert bytes(found["2"].payload) == data and found["1"].type == "revisit" and found["1"].payload_bytes == len(data)


def foreign(kind, rid, block, version="1.0", **fields):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>"] + [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return "\r\n".join(lines + [f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    typed = {"Content_Type": "application/http; msgtype=response"}
    records = [foreign("warcinfo", "i", b"software: x\r\n"),
               foreign("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>", **typed),
               foreign("response", "r1", http, WARC_Target_URI="http://one/", **typed),
               foreign("metadata", "m1", b"k: v", WARC_Concurrent_To="<q1>", Content_Type="application/warc-fields"),   # a chain
               foreign("response", "r2", http, "1.1", WARC_Concurrent_To="<q2>", **typed),                              # the other way
               foreign("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n", **typed),
               foreign("resource", "s", b"bare", "1.1"),
               foreign("metadata", "lost", b"a: b", WARC_Concurrent_To="<nobody>", Content_Type="application/warc-fields")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))                 # a member a record
    (tmp_path / "y.warc").write_bytes(foreign("resource", "whole", b"w") + foreign("resource", "cut", b"long block")[:-9])
    index = warc.record_index(spark, str(tmp_path))
    assert {r.record_id for r in index.filter("not whole").collect()} == {"<cut>"}
    found = {r.record_id: r for r in warc.captures(spark, str(tmp_path), index, with_payload=True).collect()}
    assert set(found) == {"<r1>", "<r2>", "<s>", "<whole>", None}
    assert [x.record_id for x in found["<r1>"].requests] == ["<q1>"] and found["<r1>"].metadata[0].fields == "k: v"
    assert [x.record_id for x in found["<r2>"].requests] == ["<q2>"] and found["<r2>"].metadata is None
    assert bytes(found["<r1>"].payload) == b"body" and bytes(found["<s>"].payload) == b"bare"
    assert found[None].metadata[0].record_id == "<lost>"


def test_empty_table(spark, tmp_path):
    found, got = round_trip(spark, [], f"{tmp_path}/e")
    assert got == Counter()
