"""Token ids of pages in files of independent zstandard frames with a trailing seek table.

A file is a valid zstandard stream: data frames, each followed by an empty skippable frame, and at the end a
skippable frame with the seek table. The empty frames are what the text sink writes between its rows, so Spark
itself writes the bytes, to any store it knows; no task opens a file.

Seek table, little-endian: header (file number in the partition u32, partition u32), per frame (bytes in the
file u32, bytes unpacked u32, CRC-32 of the packed frame u32, documents u32), per document (ids u64), footer
(frames u32, documents u64, magic). Frames hold the ids of whole documents, and a longer document a frame of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.base import Shelf
from sightline.llm.words import with_end, word_encoder

FRAME_BYTES = 1 << 19
FILE_BYTES = 4 << 20
# The format's skippable frame without content, the magic of skippable frames, and ours.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
SKIPPABLE = 0x184D2A5E
MAGIC = 0x5EE7AB1E
HEADER, FRAME, FOOTER = struct.Struct("<II"), struct.Struct("<IIII"), struct.Struct("<IQI")


class FileWriter:
    """The frames of one file, until it is full."""

    def __init__(self, partition: int, number: int) -> None:
        self.place = (number, partition)
        self.body = bytearray()
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.sizes.append(len(ids) // 4)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        data = b"".join(self.waiting)
        packed = self.packer.compress(data)
        self.body += packed
        self.frames.append(FRAME.pack(len(packed), len(data), zlib.crc32(packed), len(self.waiting)))
        self.waiting, self.held = [], 0

    def content(self) -> bytes:
        if self.waiting:
            self.close_frame()
        table = HEADER.pack(*self.place) + b"".join(self.frames) + np.array(self.sizes, dtype="<u8").tobytes() + FOOTER.pack(len(self.frames), len(self.sizes), MAGIC)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE, len(table)) + table


class TokenFile:
    """Reader of one file's bytes; only frames that are asked for are unpacked."""

    def __init__(self, content: bytes) -> None:
        self.content = memoryview(content)
        end = len(content) - len(EMPTY_FRAME)
        frames, documents, magic = FOOTER.unpack_from(content, end - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("no seek table at the end")
        start = end - FOOTER.size - 8 * documents - FRAME.size * frames
        self.number, self.partition = HEADER.unpack_from(content, start - HEADER.size)
        table = np.frombuffer(content, dtype="<u4", count=4 * frames, offset=start).reshape(-1, 4).astype(np.int64)
        self.packed, self.unpacked, self.checks, counts = table.T
        self.begins = np.r_[0, np.cumsum(self.packed)]
        self.sizes = np.frombuffer(content, dtype="<u8", count=documents, offset=start + FRAME.size * frames).astype(np.int64)
        self.frame_of = np.repeat(np.arange(frames), counts)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.frame_starts = self.starts[np.r_[0, np.cumsum(counts)[:-1]].astype(int)] if frames else np.empty(0, np.int64)
        self._open = (-1, b"")

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, at: int) -> bytes:
        """The ids of the file's document ``at``; its frame alone is checked and unpacked."""
        frame = int(self.frame_of[at])
        if self._open[0] != frame:
            packed = self.content[self.begins[frame]:self.begins[frame + 1]]
            if zlib.crc32(packed) != self.checks[frame]:
                raise ValueError(f"frame {frame} is damaged")
            self._open = (frame, zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.unpacked[frame]))))
        begin = 4 * int(self.starts[at] - self.frame_starts[frame])
        return self._open[1][begin:begin + 4 * int(self.sizes[at])]


def write_token_files(pages: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Write the ids of ``pages(uri, content)`` below ``path`` in ascending ``uri`` order, and return the document index.

    The index ``(partition, file, place, uri)`` is written next to the files. Null content is empty: its end id
    alone. Null ``uri`` comes first; rows that repeat a ``uri`` stand side by side. An empty table writes no document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, partition = word_encoder(vocabulary), TaskContext.get().partitionId()
        writer, uris, number = FileWriter(partition, 0), [], 0
        for batch in batches:
            for uri, ids in zip(batch.column(0).to_pylist(), (ids for portion in encoder.encoded(batch.column(1)) for ids in portion.each())):
                writer.add(with_end(ids))
                uris.append(uri)
                if len(writer.body) >= FILE_BYTES:
                    yield done(writer, uris)
                    number += 1
                    writer, uris = FileWriter(partition, number), []
        if uris:
            yield done(writer, uris)

    def done(writer: FileWriter, uris: list) -> pa.RecordBatch:
        names = pa.array(uris, kind_of[0])
        names = pa.ListArray.from_arrays(pa.array([0, len(uris)], pa.int32()), names)
        return pa.RecordBatch.from_arrays([pa.array([writer.place[1]]), pa.array([writer.place[0]]), pa.array([writer.content()], pa.binary()), names],
                                          ["partition", "file", "content", "uris"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = pages.schema["uri"].dataType
    kind_of = [to_arrow_type(kind)]
    shelf = Shelf(pages.sparkSession, "token-files")
    ordered = pages.select("uri", F.col("content").cast("string").alias("content")).repartitionByRange("uri").sortWithinPartitions("uri")
    files = shelf.keep(ordered.mapInArrow(run, f"partition bigint, file bigint, content binary, uris array<{kind.simpleString()}>"), "files")
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option(
        "compression", "none").text(f"{path}/ids")
    files.select("partition", "file", F.posexplode("uris").alias("place", "uri")).write.parquet(f"{path}/index")
    shelf.drop(files)
    return pages.sparkSession.read.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(partition, file, place, local_start, n_tokens, ids BINARY)`` of every document below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = TokenFile(content.as_py())
                for some in range(0, len(held), 1000):
                    at = range(some, min(some + 1000, len(held)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([held.partition] * len(at)), pa.array([held.number] * len(at)), pa.array(list(at), pa.int32()), pa.array(held.starts[at.start:at.stop]),
                         pa.array(held.sizes[at.start:at.stop]), pa.array([held.ids(i) for i in at], pa.binary())],
                        ["partition", "file", "place", "local_start", "n_tokens", "ids"])

    return spark.read.format("binaryFile").load(f"{path}/ids").where("length > 0").select("content").mapInArrow(
        run, "partition bigint, file bigint, place int, local_start bigint, n_tokens bigint, ids binary")


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(uri, start, n_tokens, ids_crc32)`` of every document below ``path``, read back from the files; ``start`` counts all ids before it."""
    shelf = Shelf(spark, "token-reader")
    rows = read_token_files(spark, path)
    rows = shelf.keep(rows.select("partition", "file", "place", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "documents")
    files = rows.groupBy("partition", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("partition").agg(F.sum("n").alias("n"))
    # One row per partition of the writer, then one per file of a partition.
    before = parts.select("partition", F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)).alias("p"))
    inside = files.select("partition", "file", F.sum("n").over(Window.partitionBy("partition").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)).alias("f"))
    offsets = shelf.keep(inside.join(before, "partition").select(
        "partition", "file", (F.coalesce("p", F.lit(0)) + F.coalesce("f", F.lit(0))).alias("offset")), "offsets")
    index = spark.read.parquet(f"{path}/index")
    return rows.join(index, ["partition", "file", "place"]).join(offsets, ["partition", "file"]).select(
        "uri", (F.col("offset") + F.col("local_start")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
