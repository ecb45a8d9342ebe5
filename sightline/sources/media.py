"""Folders of media files and their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.urls import suffix_kind


def media_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Media files below ``root`` by path; other files are skipped. Bytes are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.col("path").alias("uri"), "modificationTime", F.col("length").alias("size_bytes")))
    kind = suffix_kind(F.col("uri"))
    return files.select("uri", kind.alias("kind"), F.lit("local").alias("source"), F.lit(root).alias("found_on"),
                        F.col("modificationTime").alias("discovered_at"), "size_bytes").where("kind IS NOT NULL").orderBy("uri")


def media_content(spark: SparkSession, root: str) -> DataFrame:
    """The same files with the digest of their exact bytes."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .where(suffix_kind(F.col("path")).isNotNull()))
    return files.select(F.col("path").alias("uri"), suffix_kind(F.col("path")).alias("kind"),
                        *content_digest(F.col("content")))


def content_digest(content: Column) -> list[Column]:
    """SHA-256 of the exact bytes, and their number."""
    return [F.sha2(content.cast("binary"), 256).alias("sha256"), F.length(content.cast("binary")).cast("bigint").alias("size_bytes")]


def pixel_digest(pixels: Column, height: Column, width: Column) -> Column:
    """Digest of decoded pixels that also depends on their shape."""
    shape = F.concat(F.lit("("), height.cast("string"), F.lit(", "), width.cast("string"), F.lit(", 3)"))
    return F.sha2(F.concat(F.encode(shape, "UTF-8"), pixels), 256)
