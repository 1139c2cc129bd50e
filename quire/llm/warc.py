"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables. ``payloads`` holds every
distinct payload once under its SHA-256; ``records`` holds the exact header
block of every record, with the digest that names its payload. Original
records come back by a join of the two. On writing, rows of one digest must
agree in length and in a second digest (SHA-1, the one WARC headers state);
on reading, both digests are taken again from the stored bytes. Everything is
built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # WARC-Date of all records: tables of pages state none


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: every 20 bits (five hex digits) are four
    letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1,
                             F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_urn(record_id: Column, row: Column) -> Column:
    """Record URN: 64 bits of the record's id, a bit that is set where it is
    null, and 63 bits of the row number, so that repeated ids have URNs of
    their own."""
    def hex16(n: Column) -> Column:
        return F.lpad(F.lower(F.hex(n)), 16, "0")
    null_bit = F.when(record_id.isNull(), F.lit(-(1 << 63)).cast("long")).otherwise(
        F.lit(0).cast("long"))
    h = F.concat(hex16(F.coalesce(record_id, F.lit(0).cast("long"))),
                 hex16(row.bitwiseOR(null_bit)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"))


def urn_id(header: Column, field: str) -> Column:
    """The record id that a header's URN field states; null without one."""
    h = F.replace(F.regexp_extract(header, rf"\r\n{field}: <urn:uuid:([0-9a-f-]{{36}})>\r\n", 1),
                  F.lit("-"), F.lit(""))
    stated = (h != "") & (F.substring(h, 17, 1) < "8")
    return F.when(stated, F.conv(F.substring(h, 1, 16), 16, -10).cast("long"))


def header_block(urn: Column, url: Column, kind: Column, refers_to: Column,
                 digest: Column, length: Column) -> Column:
    """Header block of a record, with the empty line that ends it. ``urn`` and
    ``refers_to`` are URNs. A revisit carries no block; fields without a value
    are left out."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    safe_url = F.regexp_replace(url, r"[\x00-\x20\x7F]", "")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind),
        line("WARC-Record-ID", urn), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", refers_to),
        line("WARC-Profile", F.when(kind == "revisit", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0"))
             .otherwise(length.cast("string"))), F.lit(CRLF))


def write_archive(rows: DataFrame, path: str, record_id: str = "record_id", url: str = "url",
                  payload: str = "payload", min_bytes: int = 0) -> None:
    """Write one record per row of ``rows`` (a binary ``payload``).

    Of the rows with one payload of at least ``min_bytes`` bytes the one of
    smallest id becomes a response, the others revisits of it; rows with
    smaller payloads are all responses. A null payload is empty; a null url
    leaves its header out; null ids come last, and rows that repeat an id and
    payload are ordered by a row number, as is part of every record's URN;
    other columns are ignored; an empty table gives an empty archive.
    """
    body = F.coalesce(F.col(payload), F.lit(b""))
    described = rows.select(
        F.col(record_id).cast("long").alias("record_id"), F.col(url).alias("url"),
        F.sha2(body, 256).alias("address"), base32_sha1(body).alias("sha1"),
        F.length(body).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row"))
    index = f"{path}/index"
    described.write.parquet(index)
    described = rows.sparkSession.read.parquet(index)

    order = F.struct(F.col("record_id").isNull(), "record_id", "row")
    first = described.groupBy("address").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"),
        # One address must mean one length and one second digest.
        (F.min("sha1") == F.max("sha1")).alias("same"),
        (F.min("length") == F.max("length")).alias("as_long"))
    checked = first.withColumn("n", F.when(F.col("same") & F.col("as_long"), F.col("n")).otherwise(
        F.raise_error(F.concat(F.lit("digest clash at "), F.col("address"))).cast("long")))
    # Written, so that its true size decides how it is joined: payload bytes
    # move only if the table of shared payloads is large itself.
    checked.filter("n > 1").select("address", "first").write.parquet(f"{path}/shared")
    shared = rows.sparkSession.read.parquet(f"{path}/shared")

    # Rows of payloads that occur once need no join partner.
    told = described.join(shared, "address", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) \
        & (F.col("length") >= min_bytes)
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, record_urn(F.col("first.record_id"), F.col("first.row")))
    told.select("address", header_block(
        record_urn(F.col("record_id"), F.col("row")), F.col("url"), kind, refers, F.col("sha1"),
        F.col("length")).alias("header")) \
        .write.parquet(f"{path}/records")

    # Payload bytes are written where they are read; only the copies are
    # reduced, by their address.
    addressed = rows.select(F.sha2(body, 256).alias("address"), body.alias("payload"))
    repeated = shared.select("address")
    addressed.join(repeated, "address", "left_anti") \
        .unionByName(addressed.join(repeated, "address", "left_semi")
                     .dropDuplicates(["address"])) \
        .write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with both digests and the length taken from the bytes;
    bytes that do not match their address stop the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    return stored.select(
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))
            .cast("string")).alias("address"),
        F.col("payload"), F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: ``record_id``, ``record_type``, ``refers_to``, ``header``,
    ``payload``, ``payload_bytes``, ``payload_digest`` and ``record``, the
    original record's bytes. Ids and type are read from the header, digests
    and length from the stored bytes; columns not asked for are not moved by
    the join."""
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(read_payloads(spark, path), "address")
    kind = F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1)
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        urn_id(F.col("header"), "WARC-Record-ID").alias("record_id"), kind.alias("record_type"),
        urn_id(F.col("header"), "WARC-Refers-To").alias("refers_to"), "header", "payload",
        "payload_bytes", "payload_digest",
        F.concat(F.col("header").cast("binary"), block, F.lit((CRLF * 2).encode()))
        .alias("record"))
