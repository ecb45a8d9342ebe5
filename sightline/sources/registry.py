"""Registry tables: provenance log, assets, identities, evidence."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE_SCHEMA = "asset_id STRING, sha256 STRING, created_at STRING, parent_asset STRING, watermark_id STRING"
ASSET_SCHEMA = ("asset_id STRING, user_id STRING, sha256 STRING, phash STRING, dhash STRING, width INT, height INT, "
                "watermark_code STRING, distribution_id STRING, protected_path STRING, created_at STRING, "
                "shielded BOOLEAN")

FILES_A_TASK = 512


def latest_entries(entries: DataFrame, key: str = "asset_id", ord: str = "ord") -> DataFrame:
    """Last entry per key, placed where the key was first written (``position``)."""
    fields = [c for c in entries.columns if c not in (key, ord)]
    out = entries.groupBy(key).agg(F.max_by(F.struct(*fields), ord).alias("e"), F.min(ord).alias("position"))
    return out.select(key, "e.*", "position")


def parse_provenance(lines: DataFrame) -> DataFrame:
    """``(ord, line)`` JSON lines to entries; blank and malformed lines are skipped."""
    parsed = lines.select("ord", F.from_json("line", PROVENANCE_SCHEMA).alias("e"))
    return parsed.where(F.col("e.asset_id").isNotNull()).select("e.*", "ord")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSONL log, the latest line per asset, in write order.

    Lines of ``append_provenance`` carry their batch and row. Other logs are ordered by the time of their file, then by
    its name and their place in it. ``position`` is a struct that sorts by first writing.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start",
                                         F.monotonically_increasing_id().alias("n"))
    written = F.from_json("value", "batch BIGINT, row BIGINT")
    order = F.struct(F.coalesce(written["batch"], F.unix_micros("file_modification_time") * 1000).alias("batch"), F.coalesce(written["row"], F.lit(-1).cast("bigint")).alias("row"),
                     F.when(written["row"].isNull(), F.struct("file_path", "file_block_start", "n")).alias("place"))
    return latest_entries(parse_provenance(lines.select(order.alias("ord"), F.col("value").alias("line"))))


def append_provenance(nodes: DataFrame, path: str) -> None:
    """Append nodes as JSON lines; each says when its batch was written and which row of it it is."""
    fields = [c.split()[0] for c in PROVENANCE_SCHEMA.split(", ")]
    numbered = nodes.select(*fields, F.lit(time.time_ns()).alias("batch"), F.monotonically_increasing_id().alias("row"))
    numbered.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def assets_sink(assets: DataFrame, path: str) -> None:
    """One JSON document per asset, each a file of its own in a new folder.

    Files cost time by their number, so the rows are spread over tasks by it, and every task puts its own files in place
    (where the job does, the driver moves one after the other).
    """
    tasks = max(1, math.ceil(assets.count() / FILES_A_TASK))
    writer = assets.repartition(tasks, "asset_id").write.option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def assets_table(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """One JSON document per asset; unreadable ones are skipped, optionally one owner's only."""
    raw = (spark.read.schema(ASSET_SCHEMA + ", _corrupt STRING").option("multiLine", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))
    good = raw.where(F.col("_corrupt").isNull() & F.col("asset_id").isNotNull()).drop("_corrupt")
    return good if user_id is None else good.where(F.col("user_id") == user_id)


def upsert(table: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` replacing what has the same key."""
    on = [key] if isinstance(key, str) else list(key)
    return table.join(rows.select(*on).distinct(), on, "left_anti").unionByName(rows)


def safe_name(user_id: Column) -> Column:
    """File-safe user name."""
    return F.regexp_replace(user_id, r"[^A-Za-z0-9_.-]", "_")


def save_identities(identities: DataFrame, vectors: DataFrame, path: str) -> None:
    """Metadata and vectors are kept apart, since vectors are the sensitive part."""
    identities.withColumn("file_name", safe_name(F.col("user_id"))).write.mode("overwrite").parquet(f"{path}/identities")
    vectors.write.mode("overwrite").parquet(f"{path}/identity_vectors")


def load_identities(spark: SparkSession, path: str, require: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables, users sorted; metadata without vectors or a missing required user is an error."""
    identities = spark.read.parquet(f"{path}/identities")
    vectors = spark.read.parquet(f"{path}/identity_vectors")
    orphan = identities.join(vectors.select("user_id").distinct(), "user_id", "left_anti").select("user_id").first()
    if orphan is not None:
        raise ValueError(f"identity without vectors: {orphan['user_id']}")
    if require:
        there = {r["user_id"] for r in identities.where(F.col("user_id").isin(*require)).select("user_id").distinct().collect()}
        for user in require:
            if user not in there:
                raise ValueError(f"identity not enrolled: {user}")
    return identities.orderBy("user_id"), vectors


def delete_identity(identities: DataFrame, vectors: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame]:
    keep = F.col("user_id") != user_id
    return identities.where(keep), vectors.where(keep)


def evidence_rows(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Evidence with a deterministic id and its JSON document."""
    text = F.to_json(F.struct(*records.columns))
    analysis = F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 16)
    return records.select("*", analysis.alias("analysis_id"), text.alias("report"))


def evidence_sink(records: DataFrame, path: str, key: Sequence[str], partition: str | None = None) -> None:
    writer = evidence_rows(records, key).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def evidence_read(spark: SparkSession, path: str, analysis_id: str | None = None, newest: str = "created_at") -> DataFrame:
    """One record by id, or all ids newest first."""
    stored = spark.read.parquet(path)
    if analysis_id is not None:
        return stored.where(F.col("analysis_id") == analysis_id)
    return stored.select("analysis_id", newest).orderBy(F.col(newest).desc(), "analysis_id")


def register_protected(assets: DataFrame, settings_json: str = "{}") -> tuple[DataFrame, DataFrame]:
    """Provenance nodes (the source, then the protected asset descending from it) and registry rows."""
    source_id = F.concat(F.col("asset_id").cast("string"), F.lit(":source"))
    node = lambda ident, sha, parent, code: F.struct(
        ident.alias("asset_id"), sha.alias("sha256"), F.col("created_at"), parent.alias("parent_asset"),
        code.alias("watermark_id"))
    nothing = F.lit(None).cast("string")
    nodes = assets.select(F.explode(F.array(
        node(source_id, F.col("source_sha256"), nothing, nothing),
        node(F.col("asset_id").cast("string"), F.col("sha256"), source_id, F.col("watermark_code")),
    )).alias("n")).select("n.*")
    rows = assets.drop("source_sha256").withColumn("config_digest", F.substring(F.sha2(F.lit(settings_json), 256), 1, 12))
    return nodes, rows
