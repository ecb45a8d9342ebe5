"""Captured pages in WARC archives packed in ZIP files, written by Spark and read back by ranges.

An archive file is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.cdxj`` (one line per record with its place in the WARC file) and ``datapackage.json``. A reader finds
the members through the central directory, plain or ZIP64, and fetches each record's own bytes by the index, neighbours
together; nothing is extracted and no archive is loaded. The text sink puts one line end behind each file, which is the ZIP comment.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.base import Shelf, raw

ARCHIVE_BYTES = 8 << 20
RANGE_BYTES = 2 << 20
LEAST_PAYLOAD = 0
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
COMMENT = b"\n"
# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_of(members: list[tuple[str, bytes]], comment: bytes = b"", wide: bool = False) -> bytes:
    """A ZIP of stored members; ``wide`` (or a size beyond 32 bits) writes ZIP64 records."""
    out, central = bytearray(), bytearray()
    for name, body in members:
        here, label, crc = len(out), name.encode(), zlib.crc32(body)
        large = wide or len(body) >= FULL32 or here >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if large else b""
        size = FULL32 if large else len(body)
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if large else 20, 0, 0, 0, 33, crc, size, size, len(label), len(extra)) + label + extra + body
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), here) if large else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if large else 20, 0, 0, 0, 33, crc, size, size, len(label), len(extra), 0, 0, 0, 0,
                                         FULL32 if large else here) + label + extra
    at, count = len(out), len(members)
    out += central
    if wide or at >= FULL32 or count >= FULL16:
        end64 = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(central), at) + LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
        count, size, at = FULL16, FULL32, FULL32
    else:
        size = len(central)
    return bytes(out + END + struct.pack("<HHHHIIH", 0, 0, count, count, size, at, len(comment)) + comment)


@dataclass
class Member:
    """A stored member: where its bytes lie in the archive, and what they sum to."""

    name: str
    start: int
    size: int
    crc: int


class ZippedArchive:
    """Members of a ZIP by name, read by ranges. ``read(offset, length)`` serves the bytes."""

    def __init__(self, read, length: int) -> None:
        self.read = read
        self.members: dict[str, Member] = {}
        tail_at = max(0, length - 22 - FULL16)
        tail = read(tail_at, length - tail_at)
        end = len(tail) - 22
        while end >= 0 and not (tail[end:end + 4] == END and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
            end = tail.rfind(END, 0, end + 3)
        if end < 0:
            raise ValueError("no central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if FULL16 == count or FULL32 in (size, at):
            locator = read(tail_at + end - 20, 20)
            if locator[:4] == LOCATOR64:
                record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != END64:
                    raise ValueError("no ZIP64 directory where the locator points")
                count, size, at = struct.unpack_from("<QQQ", record, 32)
        self._directory(read(at, size), count)

    def _directory(self, data: bytes, count: int) -> None:
        at = 0
        for _ in range(count):
            if data[at:at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", data, at + 10)
            crc, packed, size, names, extras, comments = struct.unpack_from("<IIIHHH", data, at + 16)
            place, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46:at + 46 + names].decode()
            extra, end = at + 46 + names, at + 46 + names + extras
            while extra + 4 <= end:
                kind, n = struct.unpack_from("<HH", data, extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", data, extra + 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    place = next(wide) if place == FULL32 else place
                extra += 4 + n
            at += 46 + names + extras + comments
            if method == 0:  # only stored members can be read by ranges
                names, extras = struct.unpack("<HH", self.read(place + 26, 4))
                self.members[name] = Member(name, place + 30 + names + extras, size, crc)

    def range(self, name: str, offset: int, length: int) -> bytes:
        member = self.members[name]
        if offset < 0 or offset + length > member.size:
            raise ValueError("the range lies outside its member")
        return self.read(member.start + offset, length)

    def whole(self, name: str) -> bytes:
        body = self.range(name, 0, self.members[name].size)
        if zlib.crc32(body) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return body


def warc_record(uri: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{uri}>",
             f"WARC-Target-URI: {one_line(url) or f'urn:page:{uri}'}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one gzip member; lengths are checked."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    if len(rest) != length + 4:
        raise ValueError("a record's length is wrong")
    head, _, payload = rest[:length].partition(b"\r\n\r\n")
    return headers, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}, payload


def page_of(reference: str) -> str:
    return reference.removeprefix("<urn:page:").removesuffix(">")


def write_archives(pages: DataFrame, path: str, least_payload: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages(uri, url, html)`` below ``path``.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least ``least_payload`` bytes
    the one with the smallest ``uri`` is a response and the others are revisits of it; smaller ones are all
    responses. Payloads are equal where SHA-256 and length agree. Which page answers for one is settled by one aggregate over digests; the join back meets a
    payload of a third of all pages in partitions that AQE splits.

    A null ``uri`` never answers for others: such rows are responses. Rows that repeat the answering ``uri`` and
    its payload are responses too. Other columns are ignored; an empty table writes no archive.
    """
    shelf = Shelf(pages.sparkSession, "archives")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("uri", F.col("url").cast("string").alias("url"), body.alias("html")).withColumns(
        {"sha256": F.unhex(F.sha2("html", 256)), "n_bytes": F.octet_length("html")})
    leaders = shelf.keep(rows.where(F.col("n_bytes") >= least_payload).groupBy("sha256", "n_bytes").agg(F.min("uri").alias("leader")), "leaders")
    placed = rows.join(leaders, ["sha256", "n_bytes"], "left").select(
        F.col("uri").cast("string").alias("uri"), "url", "html",
        F.when((F.col("uri") != F.col("leader")), F.col("leader")).cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, lines, held = [], [], 0
        for batch in batches:
            for uri, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist()):
                record = warc_record("" if uri is None else uri, url, html, refers_to)
                lines.append(json.dumps({"page": uri, "url": url, "offset": held, "length": len(record)}))
                records.append(record)
                held += len(record)
                if held >= archive_bytes:
                    yield packed(records, lines)
                    records, lines, held = [], [], 0
        if records:
            yield packed(records, lines)

    def packed(records: list[bytes], lines: list[str]) -> pa.RecordBatch:
        index = "\n".join(lines).encode()
        package = json.dumps({"profile": "data-package", "resources": [{"name": "data", "path": DATA}, {"name": "index", "path": INDEX, "hash": f"sha256:{hashlib.sha256(index).hexdigest()}"}]})
        members = [(DATA, b"".join(records)), (INDEX, index), (PACKAGE, package.encode())]
        archive = zip_of(members, COMMENT).removesuffix(COMMENT)  # the sink writes the comment
        return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["content"])

    placed.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")).write.option(
        "lineSep", COMMENT.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


class StoredFile:
    """Byte ranges of one file, in any store that Arrow's file systems open; counts what it fetches."""

    def __init__(self, path: str) -> None:
        from pyarrow.fs import FileSystem

        store, name = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        self.file = store.open_input_file(name)
        self.fetched = 0

    def read(self, at: int, length: int) -> bytes:
        data = self.file.read_at(length, at)
        if len(data) != length:
            raise ValueError("the range lies outside the file")
        self.fetched += length
        return data


def index_rows(path: str, length: int, stored: StoredFile) -> Iterator[dict]:
    """Where every record of an archive lies: from its tail, its directory and its index alone."""
    archive = ZippedArchive(stored.read, length)
    data = archive.members[DATA]
    for line in archive.whole(INDEX).decode().split("\n") if archive.members[INDEX].size else ():
        entry = json.loads(line)
        if entry["offset"] < 0 or entry["offset"] + entry["length"] > data.size:
            raise ValueError("the range lies outside its member")
        yield {"path": path, "at": data.start + entry["offset"], "length": entry["length"], "uri": entry["page"], "url": entry["url"]}


def record_row(place: dict, data: bytes) -> dict:
    """One record, checked: a response's payload against its digest and length. A revisit has no payload of its own."""
    headers, http, payload = parse_record(data)
    digest, length = headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    response = headers["warc-type"] == "response"
    if response and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {place['uri']} is damaged")
    return {"uri": place["uri"], "url": place["url"], "record_type": headers["warc-type"], "payload_bytes": length, "payload_digest": digest,
            "refers_to": None if response else page_of(headers["warc-refers-to"]), "payload": payload if response else None}


def fetched_rows(places: list[dict], open_file: Callable[[str], StoredFile] = StoredFile) -> Iterator[list[dict]]:
    """The records at some places, by path and offset: what lies side by side comes with one read of at most ``RANGE_BYTES`` (or one record)."""
    stored, path, i = None, None, 0
    while i < len(places):
        first = places[i]
        if first["path"] != path:
            stored, path = open_file(first["path"]), first["path"]
        j, end = i + 1, first["at"] + first["length"]
        while j < len(places) and places[j]["path"] == path and places[j]["at"] == end and end + places[j]["length"] - first["at"] <= RANGE_BYTES:
            end += places[j]["length"]
            j += 1
        data = stored.read(first["at"], end - first["at"])
        yield [record_row(p, data[p["at"] - first["at"]:p["at"] - first["at"] + p["length"]]) for p in places[i:j]]
        i = j


PLACES = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("uri", pa.string()), ("url", pa.string())])
RECORDS = pa.schema([("uri", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """``(path, at, length, uri, url)`` of every record in the archives below ``path``: files are listed, and only directories and indexes are fetched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(index_rows(file, length, StoredFile(file)))
                for some in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[some:some + 5000], PLACES)

    files = spark.read.format("binaryFile").load(path).where("length > 1").select("path", "length")  # without content, files are only listed
    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, at bigint, length bigint, uri string, url string")


def read_records(places: DataFrame) -> DataFrame:
    """The records at ``places(path, at, length, uri, url)``, some or all rows of an index: ``(uri, url, record_type, payload_bytes, payload_digest, refers_to, payload)``.

    Places are dealt out in stretches of an archive, so a large archive is read by many tasks and a small selection costs little more than its records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in fetched_rows(batch.to_pylist()):
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    stretch = F.floor(F.col("at") / RANGE_BYTES)
    dealt = places.select("path", "at", "length", "uri", "url").repartition("path", stretch).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, "uri string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(uri STRING, url, record_type, payload_bytes, payload_digest, refers_to, payload BINARY)`` of every record below ``path``.

    Directories and indexes are read first, then the records' own ranges. A response's payload is checked against its digest
    and length. A revisit has no payload of its own. An archive may be of any size, also beyond what one row could hold.
    """
    return read_records(archive_index(spark, path))
