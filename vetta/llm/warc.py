"""Web archives: pages written as WARC transactions, and transactions assembled on reading.

A page becomes three records: the request, the response (or, where another record holds an
equal payload, a revisit that names it) and metadata. Request and metadata name the response
or revisit in ``WARC-Concurrent-To``. Spark's text writer writes the archives: a record is a
row and the blank lines that end a record are the line separator, so task commits, lost
executors and any file system are Spark's business. Reading splits files at the version
line, parses headers as expressions, and writes an index of all records without payloads;
transactions are joined on it, one nested row each, and payloads are fetched only if asked.

Reading is exact though a payload may hold version lines or whole records: a record whose
length is not the declared one shows that its file was cut too often, and the pieces of such
files alone are put together again in file order (a task a file, one record at a time).

Scale: equal payloads are found by a pre-aggregated grouping of digests; the list of repeated
payloads is joined with the pages by digest, broadcast by Spark only if its written size is
under the threshold, else sorted and merged with hot digests split. Payloads are written twice
(the numbered pages, the archives) and are moved only in the second of these cases. An archive
is as large as a read partition; compressed ones are one task each to read.

Cases: a null payload is empty; a null id has no ``page-id`` field and sorts below every
other id; a null url gives no target; blanks and line breaks in a url are percent-encoded;
of rows that repeat id and payload one is the response and the others revisit it; very long
payloads must fit a row (2 GB); an empty table gives an empty archive and no captures; a
record that is cut short (``whole`` false in the index) takes no part in captures; request
or metadata without the record they name make a capture of their own with a null type; extra
columns are never read, so names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, ship, table

MARK = "WARC/1."                        # the version lines of both versions of the format begin so
CRLF, GAP = "\r\n", "\r\n\r\n"
PRIMARY = ("response", "revisit", "resource")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1: 40 bits at a time, renamed from Spark's digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# ------------------------------------------------------------------------------------ writing
def _record_id(run: str, uid: Column, kind: str) -> Column:
    digits = F.md5(F.concat_ws("/", F.lit(run), uid.cast("string"), F.lit(kind)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: Column, date: str, content_type: str, block: Column, fields: dict[str, Column]) -> Column:
    """A record as one string, without the blank lines that end it; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields.items()]
    return F.concat(F.lit(f"{MARK}1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"),
                    *[F.coalesce(line, F.lit("")) for line in lines],
                    F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit(GAP), block)


def numbered(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """The pages, written once with a number and the digests of their payloads."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    url = F.replace(F.replace(F.replace(F.col(url_col), F.lit(" "), F.lit("%20")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return table(pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"),
                              F.monotonically_increasing_id().alias("uid"), base32_sha1(payload).alias("digest"),
                              F.unhex(F.sha2(payload, 256)).alias("sha")), "pages", "zstd")


def repeated(base: DataFrame, least: int) -> DataFrame:
    """``sha, first``: the number of the page whose record is the response, for payloads of at
    least ``least`` bytes that several pages hold: the one with the largest id."""
    groups = base.filter(F.octet_length("payload") >= least).groupBy("sha") \
        .agg(F.max(F.struct("page_id", "uid")).alias("best"), F.count("*").alias("n"))
    return table(groups.filter("n > 1").select("sha", F.col("best.uid").alias("first")), "repeated")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 0, compression: str = "gzip") -> None:
    """Write ``pages`` as archives under ``path``: a request, a response or revisit, and a
    metadata record a page. Payloads may be text or binary."""
    base = numbered(pages, id_col, url_col, payload_col)
    rows = base.join(repeated(base, least).withColumnRenamed("sha", "of"), F.col("sha") == F.col("of"), "left")
    run, date = uuid.uuid4().hex, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    uid, first, url = F.col("uid"), F.col("first"), F.col("url")
    again = first.isNotNull() & (first != uid)
    own = _record_id(run, uid, "capture")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(GAP))
    body = F.when(again, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    capture = _record(F.when(again, "revisit").otherwise("response"), date, "application/http;msgtype=response", body, {
        "WARC-Record-ID": own, "WARC-Target-URI": url, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Refers-To": F.when(again, _record_id(run, first, "capture")),
        "WARC-Profile": F.when(again, F.lit(REVISIT_PROFILE))})
    target = F.coalesce(url, F.lit(""))
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract(target, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")),
                   F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract(target, r"^[A-Za-z]+://([^/?#]*)", 1), F.lit(GAP))
    request = _record(F.lit("request"), date, "application/http;msgtype=request", ask, {
        "WARC-Record-ID": _record_id(run, uid, "request"), "WARC-Target-URI": url, "WARC-Concurrent-To": own})
    notes = F.coalesce(F.concat(F.lit("page-id: "), F.url_encode(F.col("page_id").cast("string")), F.lit(CRLF)), F.lit(""))
    metadata = _record(F.lit("metadata"), date, "application/warc-fields", notes, {
        "WARC-Record-ID": _record_id(run, uid, "metadata"), "WARC-Target-URI": url, "WARC-Concurrent-To": own})
    rows.select(F.explode_outer(F.array(request, capture, metadata)).alias("value")) \
        .write.option("lineSep", GAP).option("compression", compression).text(path)


# ------------------------------------------------------------------------------------ reading
def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, with its file and its order in it."""
    return spark.read.option("lineSep", MARK).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("nth"))


def _framed(pieces: DataFrame) -> DataFrame:
    """Adds the header and whether the piece is as long as the header says."""
    split = pieces.withColumn("head", F.substring_index("value", GAP, 1))
    size = F.regexp_extract("head", r"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*$", 1).try_cast("long")
    sized = split.withColumn("length", size)
    ends = F.octet_length("head") + 4 + F.col("length") + 4
    return sized.withColumn("whole", F.coalesce(ends == F.octet_length("value"), F.lit(False)))


def _rejoined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of whole files in order -> their records, by the declared lengths."""
    import re
    mark, gap = MARK.encode(), GAP.encode()
    file, parts, have, need = None, [], 0, None

    def wanted(data: bytes) -> int | None:
        head, found, _ = data.partition(gap)
        size = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
        return len(head) + 8 + int(size[1]) if found and size else None

    for frame in frames:
        out = []
        for name, piece in zip(frame["file"], frame["value"]):
            piece = bytes(piece)
            if name != file:
                if have:
                    out.append((file, b"".join(parts)))
                file, parts, have, need = name, [], 0, None
            if not parts and not piece:                 # before the first version line
                continue
            added = piece if not parts else mark + piece
            parts.append(added)
            have += len(added)
            if need is None:
                parts = [b"".join(parts)]
                need = wanted(parts[0])
            if need is not None and have >= need:
                out.append((name, b"".join(parts)))
                parts, have, need = [], 0, None
        yield pd.DataFrame(out, columns=["file", "value"])
    if have:
        yield pd.DataFrame([(file, b"".join(parts))], columns=["file", "value"])


def _parsed(framed: DataFrame) -> DataFrame:
    block = F.when(F.col("whole"), F.expr("substring(cast(value as binary), octet_length(head) + 5, cast(length as int))"))
    rows = framed.select(
        "file", "whole", "length", _field("WARC-Record-ID").alias("record_id"), F.lower(_field("WARC-Type")).alias("type"),
        _field("WARC-Date").alias("date"), _field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*(.*?)[ \t]*$"), F.lit(1)).alias("concurrent_to"),
        _field("WARC-Refers-To").alias("refers_to"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.lower(F.coalesce(_field("Content-Type"), F.lit(""))).alias("content_type"), block.alias("block"))
    http = F.col("content_type").startswith("application/http")
    rows = rows.withColumn("http_head", F.when(http, F.substring_index(F.col("block").cast("string"), GAP, 1)))
    return rows.withColumn("payload", F.when(http, F.expr("substring(block, octet_length(http_head) + 5, cast(length as int))"))
                           .otherwise(F.col("block")))


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """One written row per record, without its payload: ``file, cut, whole, record_id, type,
    date, target_uri, concurrent_to, refers_to, payload_digest`` (as declared), ``found_digest``
    and ``payload_bytes`` (of a revisit: as its HTTP header says), ``http_head, fields`` (of
    warc-fields records). ``cut``: the file had to be put together again."""
    told = F.regexp_extract("http_head", r"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*$", 1).try_cast("long")

    def narrow(rows: DataFrame, cut: bool) -> DataFrame:
        stored = F.col("type").isin("response", "resource")
        return rows.select(
            "file", F.lit(cut).alias("cut"), "whole", "record_id", "type", "date", "target_uri", "concurrent_to", "refers_to",
            "payload_digest", F.when(stored, base32_sha1(F.col("payload"))).alias("found_digest"),
            F.when(F.col("type") == "revisit", told).when(stored, F.octet_length("payload").cast("long")).alias("payload_bytes"),
            "http_head", F.when(F.col("content_type").startswith("application/warc-fields"), F.col("block").cast("string")).alias("fields"))

    plain = table(narrow(_parsed(_framed(_pieces(spark, path).filter("value <> ''"))), False), "records")
    broken = plain.filter("not whole").select("file").distinct()
    if broken.isEmpty():
        return plain
    mended = table(narrow(_parsed(_framed(_whole_files(spark, path, broken))), True), "records-mended")
    return plain.join(broken, "file", "left_anti").select(*mended.columns).unionByName(mended)


def _whole_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    ship(spark)
    pieces = _pieces(spark, path).join(files, "file", "left_semi").withColumn("value", F.col("value").cast("binary"))
    ordered = pieces.repartition("file").sortWithinPartitions("file", "block_start", "nth").select("file", "value")
    return ordered.mapInPandas(_rejoined, "file string, value binary").withColumn("value", F.col("value").cast("string"))


def payloads(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``record_id, payload`` (binary) of the whole records of ``path``."""
    broken = index.filter("cut").select("file").distinct()
    plain = _pieces(spark, path).filter("value <> ''").join(broken, "file", "left_anti").select("file", "value")
    both = plain.unionByName(_whole_files(spark, path, broken)) if not broken.isEmpty() else plain
    return _parsed(_framed(both)).filter("whole").select("record_id", "payload")


def _transactions(index: DataFrame) -> DataFrame:
    """``index`` with ``key``, equal for the records of one transaction: the id of its response,
    revisit or resource, or if some record names none of those (chains, links from the
    response), the component of the records that name one another."""
    named = index.withColumn("target", F.when(F.col("type").isin(*PRIMARY), F.col("record_id"))
                             .otherwise(F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id"))))
    ids = index.filter(F.col("type").isin(*PRIMARY)).select(F.col("record_id").alias("target")).distinct()
    odd = named.filter(~F.col("type").isin(*PRIMARY)).join(ids, "target", "left_anti")
    several = index.filter((F.size("concurrent_to") > 1) | (F.col("type").isin(*PRIMARY) & (F.size("concurrent_to") > 0)))
    if odd.isEmpty() and several.isEmpty():
        return named.withColumnRenamed("target", "key")
    links = index.select(F.xxhash64("record_id").alias("u"), F.explode("concurrent_to").alias("to")) \
        .select("u", F.xxhash64("to").alias("v"))
    roots = components(links).select(F.col("node").alias("own"), "root")
    return index.withColumn("own", F.xxhash64("record_id")).join(roots, "own", "left") \
        .withColumn("key", F.coalesce("root", "own").cast("string")).drop("own", "root")


def captures(spark: SparkSession, path: str, index: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """One nested row per capture: ``record_id, type, date, target_uri, payload_digest,
    found_digest, payload_bytes, refers_to, http_head, requests, metadata`` (arrays of
    structs), and ``payload`` if asked (null for a revisit)."""
    index = record_index(spark, path) if index is None else index
    records = _transactions(index.filter("whole and record_id is not null and type is not null"))
    requests = records.filter("type = 'request'").groupBy(F.col("key").alias("of_request")) \
        .agg(F.sort_array(F.collect_list(F.struct("record_id", "http_head"))).alias("requests"))
    notes = records.filter("type = 'metadata'").groupBy(F.col("key").alias("of_notes")) \
        .agg(F.sort_array(F.collect_list(F.struct("record_id", "fields"))).alias("metadata"))
    main = records.filter(F.col("type").isin(*PRIMARY)).drop("file", "cut", "whole", "concurrent_to", "fields")
    sides = requests.join(notes, F.col("of_request") == F.col("of_notes"), "full") \
        .withColumn("side", F.coalesce("of_request", "of_notes")).drop("of_request", "of_notes")
    out = main.join(sides, F.col("key") == F.col("side"), "full").drop("key", "side")
    if with_payload:
        found = payloads(spark, path, index).withColumnRenamed("record_id", "of")
        out = out.join(found, F.col("record_id") == F.col("of"), "left").drop("of") \
            .withColumn("payload", F.when(F.col("type") != "revisit", F.col("payload")))
    return out


def with_page_ids(found: DataFrame) -> DataFrame:
    """Captures of archives by :func:`write_warc`: ``page_id`` (text) of each, and
    ``refers_to_page``, that of the response which a revisit names."""
    own = F.url_decode(F.nullif(F.regexp_extract(F.get("metadata", F.lit(0))["fields"], r"(?m)^page-id: (.*?)\r?$", 1), F.lit("")))
    known = table(found.withColumn("page_id", own), "captures")
    named = known.filter("type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to_page"))
    return known.join(named, F.col("refers_to") == F.col("of"), "left").drop("of")
