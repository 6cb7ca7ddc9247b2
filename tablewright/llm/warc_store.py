"""Content-addressed WARC archive.

An archive is two Parquet tables in a folder: ``payloads`` holds each distinct payload once under its SHA-256, and
``headers`` the exact header bytes of every WARC/1.1 record, its HTTP head and the digest of its payload. Reading
recomputes every stored payload's SHA-256 before it is used, and joins headers to payloads to give the original records
back. :func:`write_warc` lays an archive out as .warc files and :func:`read_warc` parses such files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.llm.name_filter import filter_of, may_hold
from tablewright.llm.storage import PIECE, drop, lean, shared_dir, written

#: Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does (fixed values).
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Fixed value: the profile of a revisit whose payload is that of the record it refers to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1 of a binary column: each five hex digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _uuid(*parts: Column) -> Column:
    """A record id made from what it identifies."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cut = [F.substring(digest, a + 1, n) for a, n in ((0, 8), (8, 4), (12, 4), (16, 4), (20, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def http_head(n_bytes: Column) -> Column:
    """The HTTP head of a page of which only the body is known."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF * 2))


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = DATE) -> str:
    """Write a record per row of ``pages(page_id, url, html)``; returns the archive's folder.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response and
    the others revisit it; shorter ones are all responses. A response's block is an HTTP head and the payload, a
    revisit's the head alone, under the profile for identical payload digests. Record ids are unique, rows that repeat
    included. A null html is an empty payload; a null url is written as about:blank and marked. Rows that repeat a
    page_id and its payload are alike: all responses, or all revisits. A null page_id is kept and never the one
    revisited unless no equal payload has an id. A payload of any length is one row; an empty table gives an empty
    archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digests = written(
        rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")),
        "digests",
    )
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = written(digests.groupBy("sha256").agg(least.alias("f")).select("sha256", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "first")
    copy = F.row_number().over(Window.partitionBy("page_id", "url", "sha256").orderBy("n_bytes"))
    told = digests.withColumn("copy", copy).join(first, "sha256")
    revisit = F.coalesce((F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    only = lambda c: F.when(F.col("revisit"), c)
    url = F.coalesce("url", F.lit("about:blank"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", only(F.lit(PROFILE))),
        _line("WARC-Refers-To", only(_uuid(F.col("first"), F.col("first_url"), F.col("sha256"), F.lit(1)))),
        _line("WARC-Refers-To-Target-URI", only(F.coalesce("first_url", F.lit("about:blank")))),
        _line("WARC-Refers-To-Date", only(F.lit(date))),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page-ID", only(F.col("first"))),
        _line("X-Null-URI", F.when(F.col("url").isNull(), "true")),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", F.octet_length("head") + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))),
        F.lit(CRLF),
    )
    told = told.withColumn("revisit", revisit).withColumn("head", http_head(F.col("n_bytes")))
    told.select("sha256", header.alias("header"), "head").write.parquet(f"{path}/headers")
    # One row per distinct payload: only rows of the first page_id of a payload are dealt out, by page_id, so copies of
    # one payload spread out and stay where they are; a payload without any id is dealt apart.
    held = first.where("first is not null").select(F.col("first").alias("page_id"), "sha256")
    mine = rows.where(may_hold(rows, filter_of(held.select(F.xxhash64("page_id").alias("name")).distinct()), F.xxhash64("page_id")))
    hashed = mine.where("page_id is not null").select("page_id", F.sha2("payload", 256).alias("sha256"), "payload")
    stored = hashed.join(held, ["page_id", "sha256"]).dropDuplicates(["page_id", "sha256"])
    nameless = rows.where("page_id is null").select(F.sha2("payload", 256).alias("sha256"), "payload").join(first.where("first is null").select("sha256"), "sha256").groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.select("sha256", "payload").unionByName(nameless).write.option("compression", "zstd").parquet(f"{path}/payloads")
    drop(digests, first)
    return path


def _part(name: str, value: str, header: str = "header") -> Column:
    """A header line's value, or null."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ({value})\r\n", 1), F.lit(""))


def _parsed() -> list[Column]:
    """Columns that a record's header tells."""
    return [
        _part("X-Page-ID", r"-?\d+").cast("long").alias("page_id"),
        F.when(_part("X-Null-URI", "true").isNull(), _part("WARC-Target-URI", r"[^\r\n]*")).alias("url"),
        _part("WARC-Type", r"\w+").alias("record_type"),
        _part("WARC-Record-ID", r"[^\r\n]*").alias("record_id"),
        _part("X-Refers-To-Page-ID", r"-?\d+").cast("long").alias("refers_to"),
    ]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, url, record_type, record_id, refers_to, header, block, payload, payload_bytes, payload_digest.

    Everything comes from the stored bytes: fields are parsed from headers, length and digest are those of the stored
    payload, whose SHA-256 is verified first. A payload that doesn't match its digest, or a record whose stated SHA-1
    differs, is an error. ``block`` is what stands after the header in a .warc file.
    """
    good = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("sha256"))))
    payloads = spark.read.parquet(f"{path}/payloads").select(
        good.alias("sha256"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    records = spark.read.parquet(f"{path}/headers").join(payloads, "sha256", "left")
    checked = F.when(_part("WARC-Payload-Digest", "sha1:[A-Z2-7]+") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest"))
    checked = checked.otherwise(F.raise_error(F.lit("a record's digest differs from its payload's")))
    head = F.col("head").cast("binary")
    block = F.when(_part("WARC-Type", r"\w+") == "revisit", head).otherwise(F.concat(head, F.col("payload")))
    return records.select(*_parsed(), "header", block.alias("block"), "payload", "payload_bytes", checked.alias("payload_digest"))


def write_warc(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """The records of :func:`read_archive` as .warc files of at most ``per_file`` records each: header, block, two line ends."""
    body = F.concat("header", F.col("block").cast("string")).alias("value")
    records.select(body).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


def records_of(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record of a .warc file; ValueError where it isn't one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = re.search(rb"\r\nContent-Length: (\d+)(?=\r\n)", data[at : end + 2]) if end >= 0 else None
        if not data.startswith(b"WARC/1.1\r\n", at) or length is None:
            raise ValueError(f"no WARC record at byte {at}")
        begin, after = end + 4, end + 4 + int(length[1])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield data[at:begin].decode(), data[begin:after]
        at = after + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc files: the columns of :func:`read_archive`, payloads of revisits found by the record they refer to.

    A payload whose SHA-1 isn't the stated one is an error. A file is one task's work (2 GB at most).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                headers, blocks, size = [], [], 0
                for header, block in records_of(content):
                    headers.append(header)
                    blocks.append(block)
                    size += len(block)
                    if size > PIECE:
                        yield pa.record_batch([pa.array(headers), pa.array(blocks, pa.binary())], names=["header", "block"])
                        headers, blocks, size = [], [], 0
                if headers:
                    yield pa.record_batch([pa.array(headers), pa.array(blocks, pa.binary())], names=["header", "block"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(run), "header string, block binary")
    own = found.select(*_parsed(), _part("WARC-Refers-To", r"[^\r\n]*").alias("refers"), _part("WARC-Payload-Digest", "sha1:[A-Z2-7]+").alias("stated"), "header", "block")
    # A block's HTTP head ends at its first blank line.
    head = F.octet_length(F.substring_index(F.col("block").cast("string"), CRLF * 2, 1))
    body = F.substring("block", head + len(CRLF * 2) + 1, F.octet_length("block"))
    responses = own.where("record_type = 'response'").withColumn("payload", body)
    targets = responses.select(F.col("record_id").alias("refers"), "payload")
    met = own.where("record_type = 'revisit'").join(targets, "refers", "left").select(responses.columns)
    digest = base32_sha1(F.col("payload"))
    same = F.when(F.concat(F.lit("sha1:"), digest) == F.col("stated"), digest).otherwise(F.raise_error(F.lit("a record's digest differs from its payload's")))
    every = responses.unionByName(met).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", same)
    return every.drop("refers", "stated")
