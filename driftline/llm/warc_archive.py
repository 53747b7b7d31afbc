"""Content-addressed WARC archive.

An archive is two tables in one folder: ``payloads`` holds each distinct
payload once under its SHA-256, ``headers`` holds the exact header bytes of
every record with the digest of its payload. A record is rebuilt by joining
the two. ``export_warc`` writes the rebuilt records as WARC 1.1 files.

Defined results:

* null payload: empty; null url: empty; null id: ordered after all others;
* equal payloads: the record with the smallest (id, url) is the response, the
  others are revisits of it; repeated rows are records of their own, and of
  equal ones the first is the response;
* payloads below ``min_revisit`` bytes: always responses;
* line breaks inside a url: percent-encoded, so a header stays one line; other Unicode line
  separators are ordinary characters of a line;
* very long payloads: whole, in one row each;
* empty table: empty archive;
* further columns of the input: not part of the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: alphabet of base32, profile of revisits by payload digest
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    digest = F.sha1(payload)

    def letter(i):
        group = F.conv(F.substring(digest, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
        value = F.floor(group / F.pow(F.lit(2.0), 15 - 5 * (i % 4))).cast("long") % 32
        return F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def order(page_id: str = "page_id", url: str = "url") -> Column:
    return F.struct(F.col(page_id).isNull().alias("last"), F.col(page_id).alias("page_id"),
                    F.col(url).alias("url"), F.col("occurrence"))


def header(record_type: Column, urn: Column, refers_to: Column, http: Column) -> Column:
    """Header bytes of a record, with the HTTP header that opens its block."""
    block = F.octet_length(http) + F.when(record_type == "response", F.col("payload_bytes")).otherwise(0)
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), urn), F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Profile: "), F.lit(REVISIT_PROFILE))),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To: "), refers_to)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")))
    return F.concat(lines, F.lit("\r\n\r\n"), http)


def urn(page_id: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(":"), occurrence.cast("string"), F.lit(">"))


def write_archive(df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                  html: str = "html", min_revisit: int = 0) -> None:
    """Write the archive of ``df`` to ``folder``.

    Copies of a payload meet map-side before the shuffle, so a payload that
    most rows share is not gathered. Equal digests with unequal lengths or
    SHA-1 sums would be a collision and stop the job.
    """
    pages = df.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "\r", "%0D"),
                         "\n", "%0A").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.withColumns({"digest": F.sha2("payload", 256),
                               "payload_bytes": F.octet_length("payload").cast("long")})
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")

    spark = df.sparkSession
    sums = spark.read.parquet(f"{folder}/payloads").select("digest", base32_sha1(F.col("payload")).alias("sha1"))
    rows = keyed.withColumn("check", F.sha1("payload")).groupBy("digest", "page_id", "url").agg(
        F.count("*").alias("n"), F.min("check").alias("check"), F.max("check").alias("check_max"),
        F.min("payload_bytes").alias("payload_bytes"), F.max("payload_bytes").alias("bytes_max"))
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    same = ((F.min("check") == F.max("check_max")) & (F.min("payload_bytes") == F.max("bytes_max")))
    records = rows.select("digest", "page_id", "url", "payload_bytes",
                          F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("occurrence"))
    firsts = rows.withColumn("occurrence", F.lit(1).cast("long")).groupBy("digest").agg(
        F.min(order()).alias("first"), F.assert_true(same, F.lit("SHA-256 collision")).alias("ok")
    ).filter(F.col("ok").isNull()).join(sums, "digest").withColumnRenamed("digest", "first_digest")
    joined = records.join(firsts, F.col("digest") == F.col("first_digest"))
    kind = F.when((order() == F.col("first")) | (F.col("payload_bytes") < min_revisit), "response").otherwise("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    joined.withColumn("kind", kind).select(
        "digest", header(F.col("kind"), urn(F.col("page_id"), F.col("occurrence")),
                         urn(F.col("first.page_id"), F.col("first.occurrence")), http).alias("header")
    ).write.parquet(f"{folder}/headers")


def field(name: str) -> Column:
    """Value of a header field, null if it is missing; only line feeds start a line (flag d)."""
    found = F.regexp_extract("header", rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: parsed fields, the full payload and the exact record bytes.

    Stored payloads are digested again, once each; one that does not give its
    key stops the job. A payload of many records sits in one partition of the
    join, which adaptive execution splits by records.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    fits = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("payload does not fit its digest"))
    stored = stored.withColumns({
        "ok": fits, "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": base32_sha1(F.col("payload"))}).filter(F.col("ok").isNull()).drop("ok")
    joined = spark.read.parquet(f"{folder}/headers").join(stored, "digest")
    kind = field("WARC-Type")
    page = lambda name: F.regexp_extract(field(name), "^<urn:page:(-?[0-9]*):", 1)
    number = lambda name: F.when(page(name) != "", page(name)).cast("long")
    return joined.select(
        number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"),
        "payload_bytes", "payload_digest", kind.alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), "header", "payload",
        F.concat(F.encode("header", "UTF-8"), F.when(kind == "response", F.col("payload")).otherwise(
            F.lit("").cast("binary")), F.lit("\r\n\r\n").cast("binary")).alias("record"))


def export_warc(spark: SparkSession, folder: str, out: str) -> None:
    """The records as WARC files, one per partition; the line separator ends each record."""
    record = F.col("record").cast("string")
    read_archive(spark, folder).select(
        F.substring(record, F.lit(1), F.length(record) - 4).alias("value")
    ).write.option("lineSep", "\r\n\r\n").text(out)
