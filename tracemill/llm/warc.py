"""WARC records as a chunked record table.

A record is a WARC 1.1 record: header, HTTP head, payload.  The archive table holds its bytes
as rows (archive, record, chunk, offset, crc, last, data) of at most ``chunk_bytes`` each; the
rows of an archive in the order of ``offset`` are a WARC file.  ``crc`` is the running CRC-32
of the record up to and with the chunk, so a reader finds a lost, doubled or changed chunk when
it meets it.  Writer and reader hold one chunk at a time: payloads are cut from the column's
buffer, and read through an incremental SHA-256.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.store import stored

CHUNK_BYTES = 64 << 10
#: Payloads from which equal ones are written once.
LEAST = 100
LAST = (1 << 63) - 1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVE = "archive int, record long, chunk int, offset long, crc long, last boolean, data binary"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Every page with its payload's length and digest, and the page it revisits (null: it is a response).

    Of equal payloads of ``least`` bytes or more the one with the smallest page_id is a response.
    Only digests that occur twice are joined back; they are counted by a combined aggregate.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    ).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    large = rows.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min(F.coalesce("page_id", F.lit(LAST))).alias("first"), F.count("*").alias("n"))
    own = F.coalesce("page_id", F.lit(LAST))
    return rows.join(first.where("n > 1").drop("n"), "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("first") < own, F.col("first")).alias("refers_to")
    )


def header(page: int | None, url: str | None, size: int, digest: str, refers: int | None, date: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ''.join(map(chr, range(0x21, 0x7F))))}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-Id: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = len(HTTP) + (size if refers is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace")


def pieces(parts: list, size: int) -> Iterator[bytes]:
    """The bytes of ``parts`` one after another, cut every ``size`` bytes."""
    held = bytearray()
    for part in parts:
        view, at = memoryview(part), 0
        while at < len(view):
            took = view[at : at + size - len(held)]
            held += took
            at += len(took)
            if len(held) == size:
                yield bytes(held)
                held.clear()
    if held:
        yield bytes(held)


def write_archive(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z", **names) -> DataFrame:
    """The chunk rows of all pages, to be written by the caller; see ``planned`` for what is a revisit.

    Defined cases: a null html is an empty payload; a null page_id or url has no such header, and a
    null page_id comes after all others; a null page_id is a response unless a page with an id has
    its payload; repeated rows are repeated records (of one WARC-Record-ID); other columns are
    ignored; no rows give no rows.
    """

    def run(batches):
        archive, number, offset = TaskContext.get().partitionId(), 0, 0
        rows, held = [], 0
        names = ["archive", "record", "chunk", "offset", "crc", "last", "data"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            page, url, html, size, digest, refers = batch.columns
            for k in range(batch.num_rows):
                head = header(page[k].as_py(), url[k].as_py(), size[k].as_py(), digest[k].as_py(), to := refers[k].as_py(), date)
                crc, chunk, ahead = 0, 0, None
                for data in pieces([head, HTTP, *([html[k].as_buffer()] if to is None and size[k].as_py() else []), b"\r\n\r\n"], chunk_bytes):
                    if ahead is not None:
                        rows.append((*ahead[:5], False, ahead[5]))
                    crc = zlib.crc32(data, crc)
                    ahead = (archive, number, chunk, offset, crc, data)
                    chunk, offset, held = chunk + 1, offset + len(data), held + len(data)
                    if held > 8 << 20 and rows:
                        yield make()
                        rows, held = [], 0
                rows.append((*ahead[:5], True, ahead[5]))
                number += 1
        if rows:
            yield make()

    return planned(pages, **names).mapInArrow(run, ARCHIVE)


class RecordReader:
    """Reads one record chunk by chunk."""

    def __init__(self):
        self.held, self.fields, self.crc, self.next = bytearray(), None, 0, 0
        self.left, self.size, self.sha = 0, 0, hashlib.sha256()

    def feed(self, number: int, crc: int, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if number != self.next or crc != self.crc:
            raise ValueError(f"chunk {number} does not follow: expected {self.next}")
        self.next += 1
        if self.fields is None:
            self.held += data
            end = self.held.find(b"\r\n\r\n")
            http = self.held.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if http < 0:
                return
            lines = self.held[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
            self.left = int(self.fields["Content-Length"]) - (http - end)
            data, self.held = bytes(self.held[http + 4 :]), bytearray()
        payload = data[: self.left]
        self.sha.update(payload)
        self.left -= len(payload)
        self.size += len(payload)

    def result(self) -> tuple:
        if self.fields is None or self.left:
            raise ValueError("the record ends early")
        get = self.fields.get
        number = lambda name: int(get(name)) if get(name) is not None else None
        if get("WARC-Type") == "revisit":
            return number("X-Page-Id"), number("X-Payload-Length"), get("WARC-Payload-Digest").removeprefix("sha256:"), "revisit", number("X-Refers-To-Page-Id")
        digest = self.sha.hexdigest()
        if get("WARC-Payload-Digest") != f"sha256:{digest}":
            raise ValueError("the payload differs from its digest")
        return number("X-Page-Id"), self.size, digest, "response", None


def _read(batches):
    now, reader = None, None
    for batch in batches:
        done = []
        for archive, record, chunk, crc, last, data in zip(*batch.columns, strict=True):
            key = (archive.as_py(), record.as_py())
            if key != now:
                if reader is not None:
                    raise ValueError(f"record {now} has no last chunk")
                now, reader = key, RecordReader()
            reader.feed(chunk.as_py(), crc.as_py(), data.as_buffer().to_pybytes())
            if last.as_py():
                done.append(reader.result())
                now, reader = None, None
        if done:
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if reader is not None:
        raise ValueError(f"record {now} has no last chunk")


def read_archive(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, digests computed from the payloads.

    Records of one chunk are read where they lie.  Only the chunks of larger ones are shuffled, by
    record, sorted by number, and streamed.  A missing, doubled or changed chunk is an error.
    """
    chosen = archive.select("archive", "record", "chunk", "crc", "last", "data")
    whole = (F.col("chunk") == 0) & F.col("last")
    one = chosen.where(whole).mapInArrow(_read, RECORD)
    more = chosen.where(~whole).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return one.unionByName(more.mapInArrow(_read, RECORD))


def archive_bytes(archive: DataFrame, number: int) -> Iterator[bytes]:
    """One archive as a WARC file, chunk by chunk (streamed to the driver)."""
    rows = archive.where(F.col("archive") == number).sort("offset").select("data").toLocalIterator()
    return (bytes(r["data"]) for r in rows)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    return read_archive(stored(write_archive(pages, **options)))
