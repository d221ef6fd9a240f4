"""WARC archives: write records, read them back, resolve revisits.

An archive folder holds WARC 1.0 files, each compressed with gzip as a whole. A response record's block is an HTTP response head and the
payload; a revisit record's block is the head alone, and its header names the original response.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline import runtime
from rosterline.llm import common

#: Files hold at most so many records, so that a task reads an archive file in one piece.
RECORDS_PER_FILE = 256
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
END = "\r\n"
#: Fixed values of the format.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

HEADERS = (
    "page_id long, record_id string, record_type string, uri string, payload_bytes long, payload_digest string, "
    "refers_to_record string"
)


def _record(kind: str, refers: Column, body: Column) -> Column:
    """A whole record as text, but for the two line ends that follow it. A null field has no header line."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")
    block = F.concat(F.lit(HTTP_HEAD), body)
    return F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: {kind}{END}"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers, F.lit(">"))),
        line("WARC-Profile", F.lit(REVISIT_PROFILE if kind == "revisit" else None)),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def records(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """Record fields with the payload, one row per page; a null page is empty. Ids are new for each row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.uuid().alias("record_id"),
        F.col(uri).cast("string").alias("uri"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
        payload.alias("payload"),
    )


def write(found: DataFrame, folder: str) -> None:
    """Write records: a response where ``refers_to_record`` is absent or null, else a revisit without its payload."""
    refers = F.col("refers_to_record") if "refers_to_record" in found.columns else F.lit(None).cast("string")
    value = F.when(refers.isNull(), _record("response", F.lit(None).cast("string"), F.col("payload"))).otherwise(
        _record("revisit", refers, F.lit(""))
    )
    (
        found.select(value.alias("value"))
        .write.option("lineSep", END * 2)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .option("compression", "gzip")
        .option("zlib.compress.level", "THREE")
        .text(folder)
    )


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Header fields of every record of the archives, with ``payload`` if asked for.

    A record ends where its length says, so payloads may hold anything. A payload that doesn't match its digest
    is an error, as is a record cut short.
    """
    return _parsed(_files(spark, folder), payloads).drop("file")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.col("path").alias("file"), "content")


def _parsed(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``files`` (file, content); ``answers``, if given, has the revisits of a file as record_id, refers_to_record."""
    schema = "file string, " + HEADERS + (", payload string" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("answers").to_pylist() if "answers" in batch.schema.names else [None] * len(batch)
            for file, content, answers in zip(batch.column("file").to_pylist(), batch.column("content"), given, strict=True):
                known = {a["record_id"]: a["refers_to_record"] for a in answers or []}
                found = ({**r, "file": file, "refers_to_record": known.get(r["record_id"], r["refers_to_record"])} for r in _records(content.as_buffer()))
                rows = [[row[name] for name in names] for row in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return files.mapInArrow(parse, schema)


def _records(content: pa.Buffer) -> Iterator[dict]:
    data = gzip.decompress(content)
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head_end].decode().split("\r\n")
        if version != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        begin = head_end + 4
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        payload = data[data.index(b"\r\n\r\n", begin) + 4 : end]
        digest = fields["warc-payload-digest"].partition(":")[2]
        kind = fields["warc-type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload at byte {begin} doesn't match its digest")
        yield {
            "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
            "record_id": _bare(fields["warc-record-id"]),
            "record_type": kind,
            "uri": fields.get("warc-target-uri"),
            "payload_bytes": int(fields["x-payload-length"]),
            "payload_digest": digest,
            "refers_to_record": _bare(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload": payload.decode() if kind == "response" else None,
        }
        at = end + 4


def _bare(urn: str) -> str:
    return urn.removeprefix("<urn:uuid:").removesuffix(">")


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """record_id and refers_to_record of every record that is a revisit: headers are shuffled by payload digest.

    Among equal payloads of at least ``least_bytes`` the record with the smallest page_id (then record id) is the
    original; a null page_id counts as larger than any. Only headers move; originals are an aggregate per digest
    that is joined back, so a digest on a third of all rows is combined before the shuffle. ``file`` is kept if there is one.
    """
    own = ["record_id", *(["file"] if "file" in headers.columns else [])]
    large = headers.filter(F.col("payload_bytes") >= least_bytes)
    first = large.groupBy("payload_digest", "payload_bytes").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_id")).alias("first"), F.count("*").alias("n")
    )
    first = first.filter("n > 1").select("payload_digest", "payload_bytes", F.col("first.record_id").alias("refers_to_record"))
    return (
        large.select(*own, "payload_digest", "payload_bytes")
        .join(first, ["payload_digest", "payload_bytes"])
        .filter("record_id <> refers_to_record")
        .select(*own, "refers_to_record")
    )


def deduplicate(spark: SparkSession, folder: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Read the archives in ``folder`` and write them to ``target`` with revisits in place of repeated payloads."""
    files = _files(spark, folder)
    headers = common.stored(_parsed(files).select("file", "page_id", "record_id", "payload_bytes", "payload_digest"), "headers")
    # Answers go to the file that holds the record, one row of at most RECORDS_PER_FILE per file; no payload is shuffled.
    answers = resolve(headers, least_bytes).groupBy("file").agg(F.collect_list(F.struct("record_id", "refers_to_record")).alias("answers"))
    write(_parsed(files.join(answers, "file", "left"), payloads=True), target)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages, deduplicate the archives, read them back; one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the original, for revisits). Null
    html is an empty payload; a null page_id stays null; an empty table gives no record.
    """
    spark = pages.sparkSession
    folder = folder or runtime.scratch(spark, "warc")
    write(records(pages), f"{folder}/whole")
    deduplicate(spark, f"{folder}/whole", f"{folder}/deduplicated", least_bytes)
    found = read(spark, f"{folder}/deduplicated")
    originals = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    return found.join(originals, "refers_to_record", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
