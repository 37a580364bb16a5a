"""A content-addressed WARC archive: each payload once under its SHA-256, exact record headers apart from it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir

LINE = "\r\n"
#: Fixed value: the profile that the format demands of revisit records.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """`Name: value` and a line end; nothing for a null value. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(LINE)), F.lit(""))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", revisit_from: int = 100) -> None:
    """Write `path`/payloads (digest, payload, first_page) and `path`/headers (digest, header).

    A record's header names the full payload's digest and length. Of equal payloads of at least `revisit_from` bytes the
    smallest page id is the response and the others are revisits that refer to it; shorter payloads are always responses.
    Payloads are grouped by digest *and* bytes; where one digest has two contents, the reader's check stops the job.
    Null html is the empty payload; a null url leaves its line out; a null page_id ranks last. Fully equal rows give
    equal records. Extra columns are ignored. No rows in, an empty archive out.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest", "payload").agg(F.min("page_id").alias("first_page")).write.parquet(f"{path}/payloads")
    store = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_page", F.octet_length("payload").cast("bigint").alias("n"))
    plain = rows.select("page_id", "url", "digest").join(store, "digest")
    again = (F.col("n") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    of_first = F.when(again, F.col("first_page"))
    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(REVISIT))),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("first_page"), F.col("digest")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("n"))),
        _line("X-Payload-Length", F.col("n")),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page", of_first),
        F.lit(LINE),
    )
    plain.select("digest", header.alias("header")).write.parquet(f"{path}/headers")


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null where the line is missing."""
    found = F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"\n{name}: ")), found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records joined together again: header, digest, payload (the full one, for revisits too).

    Each stored payload is hashed anew, once; a payload that does not match its digest, or two under one digest, stop the job.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    if not stored.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two payloads share one SHA-256 digest")
    store = stored.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")).alias("payload"),
    )
    return spark.read.parquet(f"{path}/headers").join(store, "digest")


def records(archive: DataFrame) -> DataFrame:
    """The exact bytes of each WARC record: header, block (empty for revisits) and the two line ends."""
    block = F.when(header_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, read them back and list: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    header = F.col("header")
    return read_archive(spark, path).select(
        header_field(header, "X-Page-Id").cast("bigint").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.replace(header_field(header, "WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("payload_digest"),
        header_field(header, "WARC-Type").alias("record_type"),
        header_field(header, "X-Refers-To-Page").cast("bigint").alias("refers_to"),
    )
