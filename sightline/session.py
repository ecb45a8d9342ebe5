"""Session helpers: table loading and reliable checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, wherever they run and whatever folder they start in.

    Rows may hold whole texts or pages, so a batch to a worker is bounded by bytes; a session's own bound stays.
    """
    context = spark.sparkContext
    if spark.conf.get(ARROW_BYTES, "64m") in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(ARROW_BYTES, "4m")
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "sightline"), "zip", home, "sightline"))
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcasting once its rows and their bytes are known to be few; a larger one is joined by shuffle.

    Meant for tables that are cheap to count (checkpointed, or a handful of groups).
    """
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sightline-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
