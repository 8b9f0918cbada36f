"""Content-addressed WARC archive: payloads once by their SHA-256, record headers as they are, records by joins.

An archive has two tables. ``payloads`` holds the bytes of each distinct payload,
under a digest that is checked when they are written (no two payloads share it) and
again when they are read. ``headers`` holds one row per record with its exact header
block (the WARC header, and the HTTP header its block begins with) and the digest of
its payload. A record is its header and, if it is a response, the payload that the
digest names; so joining the two gives back the records byte for byte.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, shared_dir, spread_join

#: Payloads of fewer bytes are written in full each time: a reference would not be shorter.
REVISIT_BYTES = 100
#: Date of all records of one archive, unless the caller names another.
DATE = "1970-01-01T00:00:00Z"
#: The end of a header block, and the profile of a record that refers to an equal payload.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of an address that would end a header line, and how they are written.
ESCAPED = {"%0D": "\r", "%0A": "\n"}


def _record_id(page_id: Column, record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), record.cast("string"), F.lit(">"))


def _field(name: str, value: Column | str) -> Column:
    """A header line; none where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _url(url: Column) -> Column:
    for code, char in ESCAPED.items():
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _checked(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def write(pages: DataFrame, path: str, date: str = DATE, least: int = REVISIT_BYTES) -> None:
    """Writes the archive of ``pages`` (page_id, url, html) to a new folder ``path``.

    Of records with equal payloads of ``least`` bytes or more that with the smallest page_id (null
    last; of repeated ids the first read) is a response, the others revisit it. Null html is
    empty. A null page_id is written as ``-``, a null url leaves its line out. Each payload crosses
    the shuffle once per task that has it, whatever the number of its records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    size = F.octet_length("html").cast("long")
    # A second, independent hash and the length: equal digests of different payloads stop the job.
    seal = F.concat_ws(":", size.cast("string"), F.xxhash64("html").cast("string"))
    stored = rows.groupBy("digest").agg(F.any_value("html").alias("html"), F.min(seal).alias("low"), F.max(seal).alias("high"))
    stored.select("digest", _checked(F.col("low") == F.col("high"), F.col("html").cast("binary"), "two payloads share a digest").alias("payload")).write.parquet(f"{path}/payloads")

    records = materialise(rows.select("page_id", "url", "digest", size.alias("size"), F.monotonically_increasing_id().alias("record")), "op13-records")
    shared = records.filter(F.col("size") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    shared = materialise(shared.filter("n > 1"), "op13-shared")  # unique payloads need no partner
    placed = spread_join(records, shared.select("digest", "first"), "digest", "record", shared.select("digest", "n"), "left")
    revisit = F.coalesce(F.col("first.record") != F.col("record"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record"))),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", _url(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.record")))),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("Content-Type", "application/http;msgtype=response"),
        _field("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    placed.select("record", "digest", header.alias("header")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Per record of an archive: record, its text, payload_digest and payload_bytes as the store has them.

    Every stored payload's digest is computed anew before the join. A header without payload, or
    a payload that its digest does not fit, stops the job.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    stored = payloads.select("digest", F.col("payload").cast("string").alias("payload"), F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    sizes = materialise(headers.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "op13-sizes")
    total, most = headers.count(), sizes.agg(F.max("n")).first()[0]
    joined = spread_join(headers, stored, "digest", "record", sizes, "left", total, most)
    intact = F.coalesce(F.col("payload_digest") == F.col("digest"), F.lit(False))
    response = F.col("header").startswith("WARC/1.1\r\nWARC-Type: response\r\n")
    text = F.concat("header", F.when(response, F.col("payload")).otherwise(""))
    return joined.select("record", _checked(intact, text, "a payload is lost or changed").alias("text"), "payload_digest", "payload_bytes")


def parsed(rows: DataFrame) -> DataFrame:
    """What the texts of ``records`` say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Header lines are read up to the first empty line, the block has the length that they name, and
    a response's payload what follows the block's own header. A record whose length or digest
    differs from what it carries stops the job.
    """
    head = F.substring_index("text", END, 1)
    both = F.substring_index("text", END, 2)
    line = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    id_of = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d+|-):", 1), F.lit("-")).cast("long")
    rows = rows.withColumn("head", head).withColumn("at", F.octet_length(both) + len(END))
    rows = rows.withColumn("kind", line("WARC-Type")).withColumn("block", F.octet_length("text") - F.octet_length("head") - len(END))
    payload = F.expr("substring(cast(text AS binary), at + 1)")
    response = F.col("kind") == "response"
    digest = F.when(response, F.sha2(payload, 256)).otherwise(F.col("payload_digest"))
    size = F.when(response, F.octet_length("text") - F.col("at")).otherwise(F.col("payload_bytes")).cast("long")
    rows = rows.select(
        id_of(line("WARC-Record-ID")).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", id_of(line("WARC-Refers-To"))).alias("refers_to"),
        ((line("Content-Length").cast("long") == F.col("block")) & (F.concat(F.lit("sha256:"), digest) == line("WARC-Payload-Digest"))).alias("ok"),
    )
    return rows.withColumn("payload_digest", _checked(F.coalesce("ok", F.lit(False)), F.col("payload_digest"), "a record differs from its header")).drop("ok")


def export(spark: SparkSession, path: str, target: str, compression: str = "none") -> None:
    """Writes the archive's records as plain WARC files, several records a file, to a new folder ``target``."""
    texts = records(spark, path).select("text")
    texts.write.option("lineSep", END).option("compression", compression).text(target)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder, reads the records back and returns what ``parsed`` finds.

    One row per page, repeated rows and null ids included; an empty table gives an empty result;
    other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/op13-archive-{uuid.uuid4().hex}"
    write(pages, path)
    return parsed(records(spark, path))
