"""Scans: analysed media to findings and a one-row report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.verdicts import level_order

DROPPED_VERDICTS = ["unrelated", "inconclusive"]


def is_flagged(verdict: Column) -> Column:
    return ~verdict.isin(DROPPED_VERDICTS)


def distinct_media(items: DataFrame) -> DataFrame:
    """What must be analysed: one item per content, from the readable ones.

    A failed item never stands in for its copies, so a broken file fails again at every place.
    """
    fields = F.struct("uri", "kind", "found_on")
    return items.where("ok").groupBy("sha256").agg(
        F.min_by(fields, "ord").alias("first"), F.min("ord").alias("ord"), F.count("*").alias("places")).select(
        "sha256", "first.*", "ord", "places")


def scan_findings(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flagged content, most urgent first: ``(sha256, uri, verdict, level, similarity, places)``."""
    found = distinct_media(items).join(verdicts, "sha256").where(is_flagged(F.col("verdict")))
    return found.orderBy(level_order(F.col("level")).desc(), F.coalesce("similarity", F.lit(0.0)).desc(), "ord")


def scan_report(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of one scan in one row."""
    media = items.where("kind IS NOT NULL")
    counts = items.agg(F.count("*").alias("discovered"), F.count_if(F.col("kind").isNull()).alias("not_media"),
                       F.count_if(F.col("kind").isNotNull() & ~F.col("ok")).alias("failures"),
                       F.count_if(F.col("kind").isNotNull() & F.col("ok")).alias("readable")).withColumn("one", F.lit(1))
    found = distinct_media(media).join(verdicts.select("sha256", "verdict"), "sha256", "left")
    analysed = found.agg(F.count("*").alias("analysed"),
                         F.count_if(is_flagged(F.col("verdict"))).alias("flagged")).withColumn("one", F.lit(1))
    return counts.join(analysed, "one").select(
        "discovered", "not_media", "analysed", (F.col("readable") - F.col("analysed")).alias("duplicates"), "failures", "flagged")
