"""Content-addressed web archive: each payload is kept once under its verified SHA-256, the exact head of every record
apart, and records are put together again by joining the two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.skew import lookup
from frostline.sources.shared import written

HEADS = "page_id long, record_type string, digest binary, head string"
PAYLOADS = "digest binary, payload binary"

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


@dataclass(frozen=True)
class Settings:
    """least_bytes: shorter payloads are written out in every record. date: of all records (pages carry none)."""

    least_bytes: int = 100
    date: str = "1970-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """One line of a head; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _uri(url: Column) -> Column:
    """A url that can't end its line: control characters and blanks are percent-encoded."""
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.length(url) > 0, url)


def _heads(records: DataFrame, settings: Settings) -> DataFrame:
    """The heads: fields of the record, blank line, and the lines of the HTTP answer before its body."""
    revisit = F.col("record_type") == "revisit"
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"), F.lit(END + END),
    )
    block = F.octet_length(answer) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    urn = lambda id_: F.concat(F.lit("<urn:uuid:"), id_, F.lit(">"))
    head = F.concat(
        F.lit(VERSION + END),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", urn(F.col("record_id"))),
        _field("WARC-Date", F.lit(settings.date)),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        _field("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))),
        _field("WARC-Refers-To", F.when(revisit, urn(F.col("first.record_id")))),
        _field("Page-Id", F.col("page_id").cast("string")),
        _field("Refers-To-Page-Id", F.when(revisit, F.col("first.page_id").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit(END),
        answer,
    )
    return records.select("page_id", "record_type", "digest", head.alias("head"))


def deposit(pages: DataFrame, folder: str, settings: Settings = Settings()) -> None:
    """Write one record per row of pages (page_id, url, html) to the archive in a new folder: tables heads and payloads.

    Of rows with equal payloads of least_bytes or more, that with the smallest page_id is the response and the others
    are revisits of it. Rows without a page_id come last; of rows that repeat a page_id one is taken, in the order of
    the files. Null html is an empty payload, a null or empty url gives no WARC-Target-URI. An empty table gives an
    empty archive. Other columns don't matter.

    Payload bytes are shuffled once, after each task has merged its own copies, so that a payload that a third of all
    rows hold is sent once a task. Equal digests must agree in length and a second hash as well, or the job fails.
    Records are small rows; those of a hot payload are left to the splitting of skewed joins.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    ids = F.md5(F.concat_ws(
        "/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex("digest"), F.col("row").cast("string")
    ))
    uuid = F.concat_ws("-", *[F.substring(ids, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    records = written(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), digest,
            F.octet_length(body).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("record_id", uuid),
        "records",
    )
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row", "record_id")
    first = records.where(F.col("size") >= settings.least_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    typed = lookup(records, first, ["digest"], "left").withColumn(
        "record_type",
        F.when(F.col("first").isNull() | (F.col("first.row") == F.col("row")), "response").otherwise("revisit"),
    )
    _heads(typed, settings).write.parquet(f"{folder}/heads")

    proof = F.struct(F.octet_length("payload"), F.xxhash64("payload"))
    payloads = pages.select(digest, body.cast("binary").alias("payload")).groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min(proof).alias("least"), F.max(proof).alias("most")
    )
    same = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(
        F.raise_error(F.lit("different payloads of one digest")).cast("binary")
    )
    payloads.select("digest", same.alias("payload")).write.parquet(f"{folder}/payloads")


def _said(name: str) -> Column:
    """A field of the record's head; null where the head lacks it. The first blank line ends the record's fields."""
    return F.nullif(F.regexp_extract("head", rf"\A(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive, read back: page_id, record_type, refers_to, payload_bytes, payload_digest, payload,
    record.

    record holds the exact bytes of the record: its head, and for a response the payload; payload is the whole payload
    of revisits too. Type, page and reference are read from the head; length and digest are taken again from the stored
    bytes, and the job fails if the digest isn't that of the head. Whoever leaves out record and payload joins digests
    only.
    """
    heads = spark.read.schema(HEADS).parquet(f"{folder}/heads")
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("found"),
    )
    joined = lookup(heads, stored, ["digest"], "left")
    response = _said("WARC-Type") == "response"
    checked = F.when(_said("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), F.col("found")), F.col("found")).otherwise(
        F.raise_error(F.lit("a payload is missing or changed"))
    )
    head = F.col("head").cast("binary")
    return joined.select(
        _said("Page-Id").cast("long").alias("page_id"), _said("WARC-Type").alias("record_type"),
        _said("Refers-To-Page-Id").cast("long").alias("refers_to"), "payload_bytes", checked.alias("payload_digest"),
        "payload", F.when(response, F.concat(head, F.col("payload"))).otherwise(head).alias("record"),
    )


def export(spark: SparkSession, folder: str, target: str) -> None:
    """Write the records of an archive as WARC files, uncompressed, into a new folder.

    Spark's text writer ends each record with the two line ends that the format asks for.
    """
    records = restored(spark, folder).select(F.col("record").cast("string"))
    records.write.option("lineSep", END + END).text(target)
