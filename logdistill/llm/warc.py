"""Content-addressed WARC archive.

``headers`` keeps every record's header bytes exactly; ``payloads`` keeps each
payload once under its SHA-256. Records come back by joining the two; every
payload read is hashed again and a wrong one stops the job.

Of the records with one payload that of the smallest page id is the response and
the others revisit it. A null page id comes after all others; rows that repeat
the smallest id are the same record and all responses. Null html is an empty
payload. Line breaks inside an address are percent-encoded in its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import with_once
from .common import packed

# Digits of a number in base 32 and the letters of RFC 4648 for them.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits are four letters."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def _header(date: str) -> Column:
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")

    def uid(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    response = F.col("kind") == "response"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", uid("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(line("WARC-Refers-To", uid("first_id"))),
        F.when(response, F.lit("")).otherwise(line("WARC-Profile", F.lit(PROFILE))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes ``{path}/payloads`` and ``{path}/headers``.

    Payloads are combined per task before they shuffle, so a payload that a
    third of the pages share moves once per task. Only digests decide who is
    the response; texts stay out of that join.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = packed(pages, page_id=F.col("page_id"), url=F.col("url"), payload=payload)
    d = with_once(d, "digest", F.sha2("payload", 256))
    (
        d.groupBy("digest").agg(F.any_value("payload").alias("payload"))
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    )
    slim = d.select(
        "page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"),
        F.octet_length("payload").alias("bytes"),
    )
    first = slim.groupBy("digest").agg(
        F.min("page_id").alias("first_id"),
        F.count("*").alias("copies"),
    )
    kind = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    full = slim.join(first, "digest").withColumn("kind", kind)
    full.select("digest", F.encode(_header(date), "UTF-8").alias("header")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/headers")


def _field(name: str, pattern: str = "([^\r]*)") -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: {pattern}\r\n", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``digest``, ``header`` and the fields read from its bytes."""
    d = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    return d.select(
        "digest", "header",
        F.expr("try_cast(regexp_extract(decode(header, 'UTF-8'), '<urn:page:([^>]*)>', 1) as bigint)").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("payload_digest"),
        F.nullif(_field("WARC-Refers-To", "<urn:page:([^>]*)>"), F.lit("")).cast("bigint").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest`` and ``payload``, each proved against its digest, with size and SHA-1."""
    d = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    wrong = F.concat(F.lit("payload is not what its digest says: "), F.col("digest"))
    return d.select(
        "digest", "payload",
        F.when(sound, F.octet_length("payload")).otherwise(F.raise_error(wrong).cast("int"))
        .cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_sha1"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its fields, its ``payload`` and ``record``, the exact WARC bytes."""
    d = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    same = F.col("payload_digest") == F.col("payload_sha1")
    wrong = F.concat(F.lit("header and payload disagree: "), F.col("digest"))
    d = d.withColumn(
        "payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(wrong))
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return d.withColumn("record", F.concat("header", body, F.encode(F.lit(END), "UTF-8")))


def export(spark: SparkSession, path: str, target: str) -> None:
    """The archive as WARC text files, gzipped per file, one record after another."""
    text = read_archive(spark, path).select(
        F.expr(f"decode(substring(record, 1, length(record) - {len(END)}), 'UTF-8')").alias("value")
    )
    text.write.option("lineSep", END).option("compression", "gzip").text(target)
