"""WARC archives: one gzip member per record, written by Spark's own committed writer, read back in order.

Records of equal payloads are stored once: the largest page_id is the response, the others are
revisits that name it. Archives are plain files of gzip members, whatever file system they are on.

Edge cases: null html is the empty payload; rows tied at the largest page_id of a payload give one
response, the others revisit it; null ids and null addresses leave their header out; an empty table
writes no record; very long payloads are one record, decompressed piece by piece.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm.rows import shards
from tabscope.scratch import materialize, new_path

MIN_REVISIT_BYTES = 0
RECORDS_PER_ARCHIVE = 2000
ARCHIVE_BYTES = 256 << 20  # payloads of an archive at most, if no single one is larger: Spark reads an archive as one value
PIECE = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("digest_ok", T.BooleanType()), T.StructField("payload", T.BinaryType()),
])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One WARC record (not compressed). ``refers_to``: (page_id of the response,) for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{_name(refers_to[0])}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _number(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


class BadRecord(ValueError):
    """The archive is not a sequence of whole records with right lengths and digests."""


def read_records(archive: bytes | memoryview) -> Iterator[Record]:
    """Records of an archive in order: member after member, a piece of compressed bytes at a time."""
    archive, at = memoryview(archive), 0
    while at < len(archive):
        if archive[at] == 0:  # padding between members
            at += 1
            continue
        member, body, want, head_end = zlib.decompressobj(wbits=31), bytearray(), None, -1
        headers: dict[str, str] = {}
        while not member.eof:
            piece = archive[at : at + PIECE]
            if not len(piece):
                raise BadRecord("the last member is cut")
            body += member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if want is None and (head_end := body.find(b"\r\n\r\n")) >= 0:
                headers = parse_head(bytes(body[:head_end]))
                want = head_end + 4 + int(headers["content-length"]) + 4
            if want is not None and len(body) > want:
                raise BadRecord("a record is longer than its Content-Length")
        if want is None or len(body) != want or body[-4:] != b"\r\n\r\n":
            raise BadRecord("a record is shorter than its Content-Length")
        block = bytes(body[head_end + 4 : -4])
        if headers.get("warc-block-digest") != f"sha1:{base32(hashlib.sha1(block).digest())}":
            raise BadRecord("a block does not match its digest")
        yield Record(headers, block)


def parse_head(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise BadRecord("no WARC version line")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def typed(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, int]:
    """(page_id, url, payload, revisit, response_id; bytes of the largest payload): which rows are stored and which refer to which.

    The largest page_id of a payload comes from counts by (payload, page_id), so a payload on a third
    of the pages is one partial sum per task. Rows tied at that id go another way: they are counted
    by (payload, page_id, url) and copied out again, the first of them as the response.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    ids = rows.groupBy("digest", "size", "page_id").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("first"))
    best = ids.groupBy("digest", "size").agg(F.max(F.struct("page_id", "n", "first")).alias("best"))
    best = best.select("digest", "size", F.col("best.page_id").alias("response_id"), F.col("best.n").alias("tied"), F.col("best.first.url").alias("first_url"))
    best = materialize(best, "warc-best")
    largest = best.agg(F.max("size")).first()[0] or 0
    small = F.col("size") < min_bytes
    is_best = F.col("page_id").eqNullSafe(F.col("response_id"))
    joined = rows.join(best, ["digest", "size"])
    plain = joined.filter(small | ~is_best | (F.col("tied") == 1))
    plain = plain.select("page_id", "url", "payload", (~small & ~is_best).alias("revisit"), "response_id")
    repeated = best.filter("tied > 1")
    if repeated.isEmpty():  # then no payload has to be moved for them
        return plain, largest
    ties = rows.join(repeated, ["digest", "size"]).filter(~small & is_best)
    ties = ties.groupBy("digest", "size", "page_id", "url", "response_id", "first_url").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    copies = ties.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    first = (F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("first_url"))
    return plain.union(copies.select("page_id", "url", "payload", (~first).alias("revisit"), "response_id")), largest


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, per_archive: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record per page below ``path``, in archives of up to ``per_archive`` records and ``archive_bytes`` of payload.

    Payloads of more than an even share of that are written apart, as many to an archive as the largest
    of them allows, so a few large pages neither make archives too long nor all of them short.

    Spark's text writer commits the files. It puts a line end after every row; here that is the zero
    byte. The last byte of a gzip member is the high byte of its length, zero below 16 MB: such a
    member is handed over without it. A longer member stays whole and has one byte of padding.
    """
    schema = T.StructType([T.StructField("member", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in shards([b"" if p is None else p for p in batch.column(2).to_pylist()]):
                part = batch.slice(start, stop - start).to_pydict()
                members = []
                for page_id, url, payload, revisit, response in zip(*(part[c] for c in ("page_id", "url", "payload", "revisit", "response_id"))):
                    member = gzip.compress(record(page_id, url, payload, (response,) if revisit else None), mtime=0)
                    members.append(member[:-1] if member[-1] == 0 else member)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    def write(rows: DataFrame, records: int) -> None:
        members = rows.mapInArrow(run, schema).select(F.col("member").cast("string").alias("value"))
        members.write.mode("append").option("lineSep", "\x00").option("maxRecordsPerFile", records).text(path)

    rows, largest = typed(pages, min_bytes)
    share = max(1, archive_bytes // per_archive)
    if largest <= share:
        write(rows, per_archive)
    else:
        size = F.coalesce(F.octet_length("payload"), F.lit(0))
        write(rows.filter(size <= share), per_archive)
        write(rows.filter(size > share), max(1, archive_bytes // largest))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of ``READ`` from the archives below ``path``; a broken archive fails the job."""
    schema = T.StructType([f for f in READ.fields if payloads or f.name != "payload"])
    arrow = to_arrow_schema(schema)

    def row(found: Record) -> dict:
        head, _, payload = found.block.partition(b"\r\n\r\n")
        digest = found.headers["warc-payload-digest"].removeprefix("sha1:")
        revisit = found.headers["warc-type"] == "revisit"
        length = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
        url = found.headers.get("warc-target-uri")
        return {
            "page_id": _number(found.headers["warc-record-id"]), "url": url and re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url),
            "record_type": found.headers["warc-type"], "refers_to": _number(found.headers["warc-refers-to"]) if revisit else None,
            "payload_bytes": length, "payload_digest": digest,
            "digest_ok": None if revisit else base32(hashlib.sha1(payload).digest()) == digest and length == len(payload),
            "payload": None if revisit else payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for found in read_records(content.as_buffer()):
                    rows.append(row(found))
                    size += len(found.block) if payloads else 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives into the shared folder and read them back, without the payloads."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False)
