"""Web archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing. Pages are grouped by the SHA-1 of their payload; the smallest page_id of a group of equal payloads of at
least `least_bytes` becomes a response record, the others revisit it and carry headers only. Smaller payloads
are all responses. Every record is a gzip member of its own. Files go through Spark's own writer and commit protocol, so a
lost executor leaves no half file: the text source writes the bytes of a member as they are, and its line
separator is an empty gzip member, which every gzip reader passes over.

Reading. A file is walked from its start. A record passes if its gzip member ends well (length and CRC), its version line,
headers and Content-Length fit, two line ends close it, and its block and payload digests hold.
After a failed check the reader searches for the next place that passes, the start of a gzip member or a version
line at the start of a line, and takes up there; the bytes between are one quarantined gap with the
reason of the first failure. So a file answers with its records and its gaps, which together with
separators cover all its bytes. Compressed and plain files, and members of several records, are all read.

Spark reads a file as one value, so an archive file has to fit into a task's memory (2 GB at most); the writer closes
one after `RECORDS_PER_FILE` records.

Defined results: a NULL html is an empty payload; pages that repeat the smallest id with an equal payload are all
responses; among equal payloads a NULL page_id stands after every other, and where all are NULL all are
responses; a NULL or unprintable address is left out or percent-encoded; an empty table gives no records; whole payloads are
kept; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkassay.llm.common import settled
from sparkassay.operators.ranks import new_folder

RECORDS_PER_FILE = 50_000
#: Rows that one batch of the reader holds at most, and bytes of payload after which it hands a batch on.
BATCH_ROWS, BATCH_BYTES = 2_000, 16_000_000
#: Compressed bytes that the reader unpacks at a time.
STEP = 1 << 15

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: An empty member: what stands between records.
SEPARATOR = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8

_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_LINE_START = re.compile(rb"(?:\A|(?<=\n))WARC/\d\.\d\r\n")

SCHEMA = (
    "path string, offset long, length long, kind string, reason string, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing -----------------------------------------------------------------------------------


def record(page_id: int | None, first: int | None, url: str | None, payload: bytes) -> bytes:
    """One record; a revisit if `first` names another page."""
    of_payload = digest(payload)
    named = f"<urn:page:{'none' if page_id is None else page_id}:{of_payload}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}:{of_payload}>"]
    head += [
        f"WARC-Payload-Digest: sha1:{of_payload}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, firsts, urls = (batch.column(c).to_pylist() for c in ("_id", "_first", "_url"))
        pages = batch.column("_payload")
        out, held = [], 0
        for i, page_id in enumerate(ids):
            out.append(member(record(page_id, firsts[i], urls[i], pages[i].as_py() or b"")))
            held += len(out[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def firsts(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, first): the smallest page_id of every payload that several pages share."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_n"))
    groups = named.where(F.col("_n") >= least_bytes).groupBy("_digest").agg(F.count("*").alias("_pages"), F.min("page_id").alias("_first"))
    return groups.where("_pages > 1").select("_digest", "_first")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record per page row in the folder `path`.

    Only digests are grouped. The table of shared payloads is settled, so that Spark knows its size and
    moves the pages for the join only where it is too large to be broadcast."""
    shared = settled(firsts(pages, least_bytes), "warc-firsts")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = F.col("url")
    rows = pages.select(
        F.col("page_id").alias("_id"),
        F.when(url.rlike(r"[\x00-\x20\x7f]"), F.url_encode(url)).otherwise(url).alias("_url"),
        payload.alias("_payload"),
        F.sha1(payload).alias("_key"),
    )
    met = rows.join(shared, F.col("_key") == F.col("_digest"), "left").select("_id", "_url", "_payload", "_first")
    members = met.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


# -- reading -----------------------------------------------------------------------------------


class Found(NamedTuple):
    """A record or a gap: bytes [start, end) of a file."""

    start: int
    end: int
    reason: str | None
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int | None
    payload_digest: str | None


class Damaged(Exception):
    """A failed check; `end` is where the record ends if its frame (version, headers, length, closing line ends) holds."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _sha1_holds(given: str | None, data: bytes) -> bool:
    return given is None or not given.startswith("sha1:") or given[5:].upper() == digest(data)


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes | None, int | None, str | None]:
    """The record at a place: where it ends, its headers, payload, the payload's length and digest."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("headers without end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("malformed header")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("headers missing")
    start = stop + len(END)
    end = start + int(length)
    if data[end : end + len(END)] != END:
        raise Damaged("length does not fit")
    block = data[start:end]
    if not _sha1_holds(headers.get("warc-block-digest"), block):
        raise Damaged("block digest differs", end + len(END))
    kind, payload, size = headers["warc-type"], block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(END)
        size = len(payload)
        if not found:
            raise Damaged("no http headers", end + len(END))
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
            payload, size = None, int(told[1]) if told else None
    elif kind == "revisit":
        payload, size = None, None
    given = headers.get("warc-payload-digest")
    if payload is not None and kind == "response" and not _sha1_holds(given, payload):
        raise Damaged("payload digest differs", end + len(END))
    of_payload = digest(payload) if payload is not None else (given or "").removeprefix("sha1:") or None
    return end + len(END), headers, payload, size, of_payload


def _unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What the member at a place holds and where it ends."""
    unpacker, parts, view = zlib.decompressobj(31), [], memoryview(data)
    # a step at a time: what is left over after a member is copied, and must not be the whole rest
    while not unpacker.eof and at < len(data):
        try:
            parts.append(unpacker.decompress(view[at : at + STEP]))
        except zlib.error as e:
            raise Damaged("gzip check failed") from e
        at += STEP
    if not unpacker.eof:
        raise Damaged("member without end")
    return b"".join(parts), min(at, len(data)) - len(unpacker.unused_data)


def records_at(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records of the member, or the plain record, at a place, and where it ends."""
    if not data.startswith(MAGIC, at):
        end, *rest = parse(data, at)
        return [Found(at, end, None, *rest)], end
    content, end = _unpacked(data, at)
    out, inner = [], 0
    try:
        while inner < len(content):
            inner, *rest = parse(content, inner)
            out.append(Found(at, end, None, *rest))
    except Damaged as e:  # places inside a member say nothing of the file; the member itself is whole
        raise Damaged(str(e), end) from e
    return out, end


def _begins_record(data: bytes, at: int) -> bool:
    """A cheap look at what a member at a place would begin with."""
    unpacker = zlib.decompressobj(31)
    try:
        start = unpacker.decompress(memoryview(data)[at : at + 4096], 5)
    except zlib.error:
        return False
    return start == b"WARC/"


def _next_valid(data: bytes, at: int) -> tuple[int, list[Found], int]:
    """The nearest place from `at` on that passes all checks: place, records, end."""
    packed = plain = at - 1
    while True:
        if packed < at:
            packed = data.find(MAGIC, at)
            packed = len(data) if packed < 0 else packed
        if plain < at:
            found = _LINE_START.search(data, at)
            plain = found.start() if found else len(data)
        place = min(packed, plain)
        if place == len(data):
            return place, [], place
        if place == plain or _begins_record(data, place):
            try:
                return place, *records_at(data, place)
            except Damaged:
                pass
        at = place + 1


def salvage(data: bytes) -> Iterator[Found]:
    """All records and gaps of a file, in their order."""
    at = 0
    while at < len(data):
        try:
            found, end = records_at(data, at)
        except Damaged as e:
            # a record in a good frame is damaged as a whole: what its payload looks like is no record
            start, (at, found, end) = at, _next_valid(data, e.end or at + 1)
            yield Found(start, at, str(e), {}, None, None, None)
        yield from found
        at = end


def _row(path: str, f: Found, payloads: bool) -> dict:
    h = f.headers
    gap = f.reason is not None
    return {
        "path": path,
        "offset": f.start,
        "length": f.end - f.start,
        "kind": "gap" if gap else "record",
        "reason": f.reason,
        "record_type": h.get("warc-type"),
        "record_id": h.get("warc-record-id"),
        "refers_to": h.get("warc-refers-to"),
        "target_uri": h.get("warc-target-uri"),
        "payload_bytes": None if gap else f.payload_bytes,
        "payload_digest": f.payload_digest,
        "payload": f.payload if payloads else None,
    }


def _reading(payloads: bool):
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, held = [], 0
                for f in salvage(content.as_py()):
                    out.append(_row(path.as_py(), f, payloads))
                    held += len(f.payload or b"") if payloads else 0
                    if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return read


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archive files in a folder: `kind` is `record` or `gap`; a gap has the `reason` of
    the failed check and its bytes as `offset` and `length`. Records in compressed files carry the place
    of their member. `payloads=False` leaves the payloads where they are checked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reading(payloads), SCHEMA)


def quarantined(archive: DataFrame) -> DataFrame:
    """The log of byte gaps: (path, offset, length, reason)."""
    return archive.where("kind = 'gap'").select("path", "offset", "length", "reason")


def page_records(archive: DataFrame) -> DataFrame:
    """Records of pages as (page_id, payload_bytes, payload_digest, record_type, refers_to), ids read from the record ids."""
    records = archive.where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.select(
        as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to")
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to a new archive in the shared folder, read it back, and give a row per page."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archive(pages, path, least_bytes)
    return page_records(read_archive(spark, path, payloads=False))
