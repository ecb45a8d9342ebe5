"""What the operators share: the shelf for intermediate tables, and Arrow helpers for tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sightline.session import shared_folder


class Shelf:
    """Intermediate tables of one call, as Parquet in the shared folder: a lost executor costs one task, not the whole plan."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.shelf_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kept in tables:
            path = jvm.org.apache.hadoop.fs.Path(kept.shelf_path)
            path.getFileSystem(conf).delete(path, True)


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def portions(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about ``most``; a single larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))
