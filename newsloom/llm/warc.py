"""WARC archive that stores every payload once, addressed by its SHA-256.

Two Parquet tables make an archive: ``payloads`` holds each different payload once, deflated, under its address;
``headers`` holds the exact bytes in front of the payload (WARC header and HTTP header) of every record, with the
address. Reading joins them again into the records as they are in a WARC file: header, payload (none in a revisit),
two line ends. The address is verified both ways: writing stops if two payloads share one, reading recomputes it,
``Content-Length`` and the SHA-1 in the header from the bytes and stops on any difference.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is the response, the
others revisit it. Only narrow rows are grouped by address. An address that holds many records is salted for the join
with its payload, in proportion to its share, so all copies together are at most twice the number of partitions.

Null payload: empty. Null id: a record without ``X-Page-ID``, smaller than all ids. Null address of the page: no
``WARC-Target-URI``; line ends in it are percent-encoded. Rows that repeat an id and a payload: any one of them is the
response, the others revisit it. Record ids depend on the place of the row in its file, so equal input files give
equal ids. Very long payloads: rows like any other. Empty table: an archive without records. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.tables import type_of, with_rows
from newsloom.plans.components import join_hot
from newsloom.plans.lineage import checkpoint_folder, cut_lineage

# Fixed values of the format.
LINE = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = LINE.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""))
CAPTURED = "1970-01-01T00:00:00Z"
READ_ROWS = 256


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1; 15 hex digits are 12 digits in base 32."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, start, size), 16, 32), size * 4 // 5, "0") for start, size in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _record_id(*parts: Column) -> Column:
    made = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(made, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _deflated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in with_rows(batches):
        packed = [zlib.compress((p or "").encode(), 1) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["address", "packed"])


def write_archive(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  revisit_from: int = 0, captured: str = CAPTURED) -> Archive:
    """Write one record per row into ``folder``, which every executor can reach."""
    spark = pages.sparkSession
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    facts = cut_lineage(pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.sha2(payload, 256).alias("address"),
        base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    facts = facts.withColumn("record_id", _record_id(F.col("id"), F.col("address"), F.col("row")))
    firsts = facts.filter(F.col("size") >= revisit_from).groupBy("address").agg(
        F.max(F.struct("id", "row", "record_id")).alias("first")).select(
        "address", F.col("first.row").alias("first_row"), F.col("first.record_id").alias("first_record"))
    rows = join_hot(facts, firsts, "address")
    again = F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"), _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.lit(captured)), _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), _field("WARC-Refers-To", F.when(again, F.col("first_record"))),
        _field("WARC-Profile", F.when(again, F.lit(PROFILE))), _field("X-Page-ID", F.col("id").cast("string")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", (F.when(again, F.lit(0)).otherwise(F.col("size")) + len(HTTP)).cast("string")), F.lit(LINE), F.lit(HTTP))
    rows.select(header.cast("binary").alias("header"), "address").write.parquet(archive.headers)
    # a payload leaves a task once however many records of the task hold it, and meets its equals on address and bytes
    packed = pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload")).mapInArrow(_deflated, "address string, packed binary")
    packed.distinct().write.parquet(archive.payloads)
    if not spark.read.parquet(archive.payloads).groupBy("address").count().filter("count > 1").isEmpty():
        raise ValueError("two different payloads have the same SHA-256")
    return archive


def _fields(headers: DataFrame) -> DataFrame:
    """Headers with the fields that joins need."""
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))

    return headers.select("header", "address", field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_record"),
                          field("X-Page-ID").alias("page"))


def _join_payloads(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every header with its payload. Addresses above one partition's share of the records are salted."""
    spark = headers.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    total = headers.count()
    # fewer than parts addresses can hold more than 1/parts of the records: a proven bound for both broadcasts
    heavy = cut_lineage(headers.groupBy("address").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * parts > total).select(
        "address", F.ceil(F.col("n") * parts / total).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    left = headers.join(F.broadcast(heavy), "address", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), copies).cast("int")).drop("copies")
    right = payloads.join(F.broadcast(heavy), "address", "left").select(
        "address", "packed", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    return left.join(right, ["address", "salt"], "left").drop("salt")


def _parse(record: bytes, payload: bytes) -> dict[str, str]:
    """Fields of a record, after checking its lengths and the digest of its payload."""
    head, _, block = record.removesuffix(b"\r\n\r\n").partition(b"\r\n\r\n")
    lines = head.decode().split(LINE)
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if lines[0] != "WARC/1.1" or int(fields["Content-Length"]) != len(block):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] == "response" and block.partition(b"\r\n\r\n")[2] != payload:
        raise ValueError(f"record {fields['WARC-Record-ID']} holds another payload")
    if fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload digest of record {fields['WARC-Record-ID']} is wrong")
    return fields


READ = pa.schema([("record", pa.binary()), ("payload", pa.binary()), ("record_id", pa.string()), ("record_type", pa.string()),
                  ("url", pa.string()), ("payload_digest", pa.string()), ("page", pa.string()), ("refers_page", pa.string())])


def _rebuilt(row: dict) -> dict:
    payload = zlib.decompress(row["packed"])
    if hashlib.sha256(payload).hexdigest() != row["address"]:
        raise ValueError(f"payload at {row['address']} is damaged")
    record = row["header"] + (b"" if row["revisit"] else payload) + b"\r\n\r\n"
    fields = _parse(record, payload)
    return {"record": record, "payload": payload, "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
            "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "page": fields.get("X-Page-ID"), "refers_page": row["refers_page"]}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in with_rows(batches):
        for start in range(0, batch.num_rows, READ_ROWS):
            yield pa.RecordBatch.from_pylist([_rebuilt(row) for row in batch.slice(start, READ_ROWS).to_pylist()], schema=READ)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records: exact bytes, full payload, and the fields of the header.

    ``page`` and ``refers_page`` are the ids as text; the latter is that of the response a revisit refers to.
    """
    headers = _fields(spark.read.parquet(archive.headers))
    responses = headers.filter("refers_record IS NULL").select(F.col("record_id").alias("original"), F.col("page").alias("refers_page"))
    # a response refers to itself here, as null keys would all meet in one task
    referred = join_hot(headers.withColumn("original", F.coalesce("refers_record", "record_id")), responses, "original")
    joined = _join_payloads(referred, spark.read.parquet(archive.payloads))
    rows = joined.select("header", "address", "packed", F.col("refers_record").isNotNull().alias("revisit"),
                         F.when(F.col("refers_record").isNotNull(), F.col("refers_page")).alias("refers_page"))
    return rows.mapInArrow(_read, "record binary, payload binary, record_id string, record_type string, url string, payload_digest string, "
                                  "page string, refers_page string")


def archived(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", revisit_from: int = 0) -> DataFrame:
    """One row per page as read back from an archive in the shared folder: id, payload bytes and digest, type, reference."""
    spark, kind = pages.sparkSession, type_of(pages, id_column)
    archive = write_archive(pages, f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}", id_column, url_column, payload_column, revisit_from)
    return read_archive(spark, archive).select(
        F.col("page").cast(kind).alias(id_column), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_page").cast(kind).alias("refers_to"))
