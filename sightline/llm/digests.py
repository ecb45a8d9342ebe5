"""Exact copies by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.base import Shelf

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
FAN_IN_BITS = 4  # sixteen runs meet in one merge
ROUNDS = 2  # merges after the first exchange: 256 runs, 16, 1
PROOF = ["sha256", "n_bytes", "proof"]


def squeezed(content: Column) -> Column:
    """Text with every stretch of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(content.cast("string"), F.lit("")), WHITE_SPACE, " ")


def content_digests(media_content: DataFrame) -> DataFrame:
    """``(uri, sha256 BINARY, n_bytes, proof)`` of each item of ``media_content(uri, content)``.

    Length and a second hash go with the SHA-256: contents count as equal only where all three agree.
    """
    text = media_content.select("uri", squeezed(F.col("content")).alias("text"))
    return text.select("uri", F.unhex(F.sha2("text", 256)).alias("sha256"), F.octet_length("text").alias("n_bytes"),
                       F.xxhash64("text").alias("proof"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """One binomial round: sixteen sorted runs become one, and equal digests keep their smallest ``uri``.

    A run is cut into slices by the leading bits of the digest, so a merge is (run, slice) and never the
    whole run. The window sorts a merge by digest and identifier; at most one row per run shares a digest.
    """
    moved = runs.withColumn("run", F.shiftright("run", FAN_IN_BITS)).repartition("run", "slice")
    equal = Window.partitionBy("run", "slice", *PROOF)
    merged = moved.withColumns({
        "turn": F.row_number().over(equal.orderBy(F.asc_nulls_last("uri"))),
        "copies": F.sum("copies").over(equal)})
    return merged.where("turn = 1").drop("turn")


def byte_copies(media_content: DataFrame) -> DataFrame:
    """Which item of each set of byte copies stays: ``(uri, kept_uri, copies, kept, sha256)``, one row per input row.

    ``media_content(uri, content)`` is fetched content under any orderable ``uri``. Each input partition
    forms a run of its distinct digests with the smallest ``uri`` (the map side of the first exchange), and
    the runs are merged in binomial rounds of sixteen. A content held by a third of all rows is therefore one
    row per run and never a hot key; only the last join meets all its rows, where AQE splits them.

    Null content equals empty content. Null ``uri`` sorts last: such a row stays only if no copy has one.
    Rows that repeat a ``uri`` and its content share one answer. Other columns are ignored; an empty table
    gives an empty table.
    """
    shelf = Shelf(media_content.sparkSession, "byte-copies")
    digests = shelf.keep(content_digests(media_content.select("uri", "content")), "digests")
    placed = digests.withColumns({"run": F.pmod(F.spark_partition_id(), F.lit(1 << (FAN_IN_BITS * ROUNDS))),
                                  "slice": F.substring("sha256", 1, 3)})
    runs = placed.groupBy("run", "slice", *PROOF).agg(F.min("uri").alias("uri"), F.count("*").alias("copies"))
    for _ in range(ROUNDS):
        runs = merge_runs(runs)
    kept = shelf.keep(runs.select(*PROOF, F.col("uri").alias("kept_uri"), "copies"), "merged")
    return digests.join(kept, PROOF).select(
        "uri", "kept_uri", "copies", F.col("uri").eqNullSafe(F.col("kept_uri")).alias("kept"),
        F.lower(F.hex("sha256")).alias("sha256"))
