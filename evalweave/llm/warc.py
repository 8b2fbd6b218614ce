"""Content-addressed web archive (operator 4), in DataFrame functions alone.

An archive has two tables.  ``payloads`` keeps each payload once under its
SHA-256, which is verified whenever payloads are read.  ``headers`` keeps the
exact header of every record, its type, and the digest of its payload; a header
names the digest as bare upper-case base32 SHA-1, as web archives do.
``records`` puts header, payload and closing line ends together again by a join;
whatever is read back is read from the bytes of these records.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the
smallest page_id (ties: url, then copy) is the response and the others revisit
it; records with smaller payloads are all responses.  Null page_ids come last
and are never preferred to others; a null url leaves its header line out; line
ends in a url are written as %0D and %0A; a null html is an empty payload.
Repeated rows are records of their own: ``copy`` numbers them.  Payloads of any
length are kept whole.  Extra columns play no part, whatever their names.  An empty
table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them make four characters."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def record_rows(pages: DataFrame, least_bytes: int) -> DataFrame:
    """A row for each record: page_id, url, copy, sha256, sha1, payload_bytes, record_type, refers_to, refers_url, refers_copy."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    seen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.length(payload).cast("long").alias("payload_bytes"))
    distinct = written(seen.groupBy("page_id", "url", "sha256", "sha1", "payload_bytes").agg(F.count("*").alias("copies")), "records")
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("url"))
    first = distinct.groupBy("sha256").agg(F.min(order).alias("first"))
    rows = distinct.join(first, "sha256").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    response = is_first | (F.col("payload_bytes") < least_bytes)
    return rows.select("page_id", "url", "copy", "sha256", "sha1", "payload_bytes", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first.page_id")).alias("refers_to"), F.when(~response, F.col("first.url")).alias("refers_url"), F.when(~response, 1).alias("refers_copy"))


def record_id(page_id: str, url: str, copy: str) -> Column:
    """A name for a record that follows from its row alone."""
    h = F.sha1(F.concat_ws("\n", F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.coalesce(F.col(url), F.lit("null")), F.col(copy).cast("string")))
    dashed = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def line_safe(url: str) -> Column:
    return F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header() -> Column:
    """The record's exact header with its closing empty line; a null part leaves its line out."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id("page_id", "url", "copy")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), line_safe("url")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id("refers_to", "refers_url", "refers_copy"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), line_safe("refers_url"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as ``path``/payloads and ``path``/headers."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    stored = pages.select(F.sha2(payload.cast("binary"), 256).alias("sha256"), payload.alias("payload")).groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.select("sha256", F.col("payload").cast("binary").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    record_rows(pages, least_bytes).select(header().alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and payload of each stored payload; a payload that isn't what its digest says raises an error."""
    rows = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("sha256")
    return rows.select(F.when(right, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("sha256"), "payload")


def field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), found)


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("header string, sha256 string").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (of the record that a revisit refers to, too) and record (the exact bytes of the archive's record)."""
    joined = headers(spark, path).join(payloads(spark, path), "sha256")
    end = F.lit("\r\n\r\n").cast("binary")
    body = F.when(field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat(F.col("header").cast("binary"), body, end).alias("record"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of each record, read from its reconstructed bytes.

    A revisit has the payload of the record that it refers to.  Bytes that don't
    end as a record, a body of another length than its header says, and a payload
    of another digest raise errors.
    """
    parts = records(spark, path).select("record", "payload", F.substring_index(F.decode("record", "UTF-8"), "\r\n\r\n", 1).alias("head"))
    start = F.length(F.encode("head", "UTF-8")) + 4
    body = F.col("record").substr(start + 1, F.length("record") - start - 4)
    end = F.col("record").substr(F.length("record") - 3, F.lit(4)) == F.lit("\r\n\r\n").cast("binary")
    header = F.concat("head", F.lit("\r\n"))
    parts = parts.select(header.alias("header"), body.alias("body"), end.alias("ended"), "payload")
    right = F.col("ended") & (F.length("body") == field("Content-Length").cast("int"))
    whole = F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    parts = parts.select("header", F.when(right, whole).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("header")))).alias("payload"))
    parts = parts.select("header", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"))
    same = field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))
    return parts.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.when(same, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("header")))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return read_archive(spark, path).drop("url")


_BITS = "list_transform(range(0, 32), lambda i: ('0x' || substr(sha1(html), (((i * 5) // 4) + 1)::int, 2) || '0')::bigint // (2 ** (7 - (i * 5) % 4))::bigint % 32)"
ORACLE_OP4 = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (
  select page_id, html, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as h, min(page_id) over (partition by sha256(html)) as first_id,
    array_to_string(list_transform({_BITS}, lambda v: substr('{BASE32}', (v + 1)::int, 1)), '') as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from d
"""
