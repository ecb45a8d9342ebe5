"""WARC archives in ZIP files: round trips, and ZIPs made by the standard library."""

import base64
import hashlib
import io
import json
import os
import struct
import zipfile
import zlib

import pytest

from sightline.llm import archives
from sightline.llm.archives import COMMENT, DATA, INDEX, StoredFile, ZippedArchive, archive_index, fetched_rows, index_rows, read_archives, read_records, warc_record, write_archives, zip_of

PAGES = "uri bigint, url string, html string, record_type string, leader string"


def opened(data):
    return ZippedArchive(lambda at, n: data[at:at + n], len(data))


@pytest.mark.parametrize("wide", [False, True])
def test_zip_reads_everywhere(wide):
    members = [("a/one", b"first"), ("two", b""), ("three", b"PK\x05\x06" * 40)]
    data = zip_of(members, b"note", wide)
    assert [(i.filename, zipfile.ZipFile(io.BytesIO(data)).read(i)) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()] == members
    archive = opened(data)
    assert [(n, archive.whole(n)) for n in archive.members] == members
    assert archive.range("a/one", 1, 3) == b"irs"
    with pytest.raises(ValueError):
        archive.range("a/one", 3, 3)


def test_standard_zip():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("stored", b"plain")
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"forced to 64 bits")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    archive = opened(held.getvalue())
    assert archive.whole("stored") == b"plain" and archive.whole("large") == b"forced to 64 bits" and "packed" not in archive.members
    with pytest.raises(ValueError):
        opened(b"no zip at all, nowhere")


@pytest.mark.parametrize("least,archive_bytes", [(0, 8 << 20), (6, 400)])
def test_round_trip(spark, tmp_path, least, archive_bytes):
    rows = [(i, f"http://site/{i}" if i % 3 else None, ["same page", "é" * 3000, "", None, f"own {i}", "tiny"][i % 6]) for i in range(60)] + [(9, "u", "again"), (9, "u", "again")]
    rows += [(None, "line\nbreak", "same page")]
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3), path, least, archive_bytes)
    got = [tuple(r) for r in read_archives(spark, path).collect()]
    want = []
    for uri, url, html in rows:
        body = (html or "").encode()
        leader = min(u for u, _, h in rows if u is not None and (h or "").encode() == body)
        revisit = uri is not None and len(body) >= least and uri != leader
        want.append((None if uri is None else str(uri), url, "revisit" if revisit else "response", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     str(leader) if revisit else None, None if revisit else body))
    key = lambda r: (str(r[0]), r[3])
    assert sorted([(*r[:6], None if r[6] is None else bytes(r[6])) for r in got], key=key) == sorted(want, key=key)
    files = [f for f in os.listdir(path) if f.startswith("part-") and os.path.getsize(f"{path}/{f}") > 1]
    assert len(files) > (10 if archive_bytes == 400 else 0)
    for f in files:
        whole = zipfile.ZipFile(f"{path}/{f}")
        assert whole.testzip() is None and DATA in whole.namelist() and whole.comment == COMMENT


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert read_archives(spark, path).count() == 0


def records_of(count):
    """The data and index members of an archive with some records."""
    records = [warc_record(str(i), None, (f"page {i} " + os.urandom(300).hex()).encode(), None) for i in range(count)]
    lines, at = [], 0
    for i, record in enumerate(records):
        lines.append(json.dumps({"page": str(i), "url": None, "offset": at, "length": len(record)}))
        at += len(record)
    return b"".join(records), "\n".join(lines).encode()


def test_one_record_costs_little(spark, tmp_path, monkeypatch):
    data, index = records_of(3000)
    path = tmp_path / "one.zip"
    path.write_bytes(zip_of([(DATA, data), (INDEX, index)], COMMENT))
    size = path.stat().st_size
    stored = StoredFile(f"file:{path}")
    places = list(index_rows(f"file:{path}", size, stored))
    assert len(places) == 3000 and stored.fetched < len(index) + 70_000 < size / 3
    opened_files = []
    count = lambda name: opened_files.append(StoredFile(name)) or opened_files[-1]
    rows = [r for some in fetched_rows(places[1700:1701], count) for r in some]
    assert rows[0]["uri"] == "1700" and sum(f.fetched for f in opened_files) == places[1700]["length"] < size / 1000
    monkeypatch.setattr(archives, "RANGE_BYTES", 20_000)
    parts = list(fetched_rows(places[5:900] + places[2000:2010], count))
    assert [r["uri"] for part in parts for r in part] == [str(i) for i in [*range(5, 900), *range(2000, 2010)]] and 10 < len(parts) < 100
    some = read_records(archive_index(spark, str(tmp_path)).where("uri = '77' OR uri = '78'")).collect()
    assert sorted(r.uri for r in some) == ["77", "78"] and all(bytes(r.payload).startswith(b"page 7") for r in some)


def test_forced_zip64_through_the_operator(spark, tmp_path):
    data, index = records_of(40)
    (tmp_path / "wide.zip").write_bytes(zip_of([(DATA, data), (INDEX, index)], COMMENT, wide=True))
    assert sorted(int(r.uri) for r in read_archives(spark, str(tmp_path)).collect()) == list(range(40))


def test_archive_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file: a stored member of 4.5 GB without blocks on disk, and the archive's own members behind it."""
    data, index = records_of(25)
    filler, path = 4_500_000_000, tmp_path / "vast.zip"
    with open(path, "wb") as f:
        f.seek(filler)  # nothing points at the filler; the directory's places count from the file's beginning
        at = f.tell()
        central = b""
        for name, body in ((DATA, data), (INDEX, index)):
            label, here = name.encode(), f.tell()
            extra = struct.pack("<HHQQ", 1, 16, len(body), len(body))
            f.write(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(label), len(extra)) + label + extra + body)
            extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), here)
            central += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(label), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + label + extra
        place = f.tell()
        f.write(central)
        end64 = f.tell()
        f.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(central), place) + b"PK\x06\x07" + struct.pack("<IQI", 0, end64, 1))
        f.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    assert at > 1 << 32
    got = read_archives(spark, str(tmp_path)).collect()
    assert sorted(int(r.uri) for r in got) == list(range(25)) and all(r.payload for r in got)
