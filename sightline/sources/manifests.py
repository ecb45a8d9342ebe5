"""Evaluation manifests, downloaded clip folders and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def identity_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``file, identity`` list."""
    return spark.read.schema("file STRING, identity STRING").csv(path, sep="\t")


def identity_from_name(file_name: Column) -> Column:
    """Without a list, the identity is the file name up to its trailing number."""
    stem = F.regexp_extract(file_name, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    return F.regexp_replace(stem, r"[_-]?\d+$", "")


def eval_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of manifest JSON files; family from ``swapper`` or the folder, people = identity and donor."""
    schema = ("records ARRAY<STRUCT<path: STRING, sha256: STRING, label: STRING, swapper: STRING, identity: STRING, "
              "donor: STRING, source: STRING>>")
    rows = (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.col("_metadata.file_path").alias("manifest"), F.explode("records").alias("r")).select("manifest", "r.*"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    people = F.array_distinct(F.array_compact(F.array("identity", "donor")))
    return rows.withColumns({"family": F.coalesce("swapper", folder), "people": people})


def dedupe_genuine(items: DataFrame, ordinal: str = "manifest_ord") -> DataFrame:
    """Genuine items shared by several manifests are kept once, from the first; fakes pass through.

    The content hash identifies an item, else its source.
    """
    key = F.coalesce("sha256", "source_name")
    genuine = items.where("label = 'genuine'")
    first = genuine.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*items.columns), F.struct(ordinal, "item")).alias("r"))
    return first.select("r.*").unionByName(items.where("label <> 'genuine'"))


# Names that a download of manipulated clips uses, normalised to letters and digits.
CLIP_METHODS = ("deepfakedetection", "neuraltextures", "faceshifter", "face2face", "deepfakes", "faceswap")
GENUINE_MARKERS = ("original", "real", "youtube")
CLIP_COMPRESSIONS = ("c23", "c0", "raw", "c40")  # best first
MASK_FOLDERS = ("mask", "masks")
CLIP_ID = r"(?<![0-9])[0-9]{3}(?:_[0-9]{3})?(?![0-9])"
CLIP_SUFFIX, FRAME_SUFFIX = r"\.(mp4|avi|mov|mkv)$", r"\.(png|jpe?g)$"


def classified_paths(paths: DataFrame, compression: str | None = "c23", methods: Sequence[str] = CLIP_METHODS, genuine: Sequence[str] = GENUINE_MARKERS,
                     compressions: Sequence[str] = CLIP_COMPRESSIONS, id_pattern: str = CLIP_ID) -> DataFrame:
    """``(path, kind, video_id, is_video, rank)`` of the clips and frames in a download's ``paths(path)``.

    Any folder, or the file's own name, that starts with a method's name gives the kind; else one that starts with a genuine
    marker gives ``real``. Masks are left out, and so is a path that names another compression than the one wanted (``None``: all); a
    path that names none is taken. The identifier is found in a video's name, or in the name of a frame's folder and then of
    the frame. ``rank`` orders compressions; unnamed ones come last.
    """
    raw = F.split(F.col("path"), "/")
    parts = F.transform(raw, lambda part: F.regexp_replace(F.lower(part), "[^a-z0-9]", ""))
    named = paths.select("path", raw.alias("raw"), parts.alias("parts"), F.lower("path").rlike(CLIP_SUFFIX).alias("is_video"))
    named = named.where(F.col("is_video") | F.lower("path").rlike(FRAME_SUFFIX))
    starts = lambda part, names: reduce(lambda found, name: F.coalesce(found, F.when(part.startswith(name), F.lit(name))), names[1:], F.when(part.startswith(names[0]), F.lit(names[0])))
    method = F.get(F.array_compact(F.transform("parts", lambda part: starts(part, list(methods)))), 0)
    real = F.exists("parts", lambda part: reduce(lambda a, b: a | b, [part.startswith(m) for m in genuine]))
    level = lambda name: F.exists("parts", lambda part: part.endswith(name))
    rank = F.lit(len(compressions))
    for i, name in reversed(list(enumerate(compressions))):
        rank = F.when(level(name), F.lit(i)).otherwise(rank)
    masked = F.exists(F.slice("parts", F.lit(1), F.greatest(F.lit(0), F.size("parts") - 1)), lambda part: part.isin(*MASK_FOLDERS))
    found = lambda text: F.nullif(F.regexp_extract(text, f"({id_pattern})", 1), F.lit(""))
    stem, folder = F.regexp_replace(F.element_at("raw", -1), r"\.[^.]*$", ""), F.when(F.size("raw") > 1, F.element_at("raw", -2))
    number = F.coalesce(F.when(~F.col("is_video"), found(folder)), found(stem))
    kept = ~masked
    if compression is not None:
        kept = kept & (level(compression) | (rank == len(compressions)))
    return named.where(kept).select("path", F.coalesce(method, F.when(real, "real")).alias("kind"), number.alias("video_id"), "is_video", rank.alias("rank")).where(
        "kind IS NOT NULL AND video_id IS NOT NULL")


def clip_inventory(paths: DataFrame, compression: str | None = "c23", wanted: Sequence[str] | None = None, **names) -> DataFrame:
    """One copy per clip of a download tree: ``(kind, video_id, path, is_video, members)``.

    A video outranks a folder of its frames, then the compression decides, then the path. ``path`` is the video, or the folder that
    holds ``members`` frames. ``wanted`` names the methods to keep beside ``real`` (all without it); other names are those of
    :func:`classified_paths`.
    """
    found = classified_paths(paths, compression, **names)
    if wanted is not None:
        found = found.where(F.col("kind").isin("real", *wanted))
    place = F.when(F.col("is_video"), F.col("path")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    copies = found.withColumn("place", place).groupBy("kind", "video_id", "is_video", "place").agg(F.min("rank").alias("rank"), F.count("*").alias("members"))
    best = F.min(F.struct((~F.col("is_video")).alias("frames"), "rank", "place", "members")).alias("b")
    return copies.groupBy("kind", "video_id").agg(best).select(
        "kind", "video_id", F.col("b.place").alias("path"), (~F.col("b.frames")).alias("is_video"), F.col("b.members").alias("members"))


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("kind").agg(F.count("*").alias("clips"))


def with_environment(rows: DataFrame, env: Mapping[str, str]) -> DataFrame:
    """Constant provenance columns on every result row."""
    return rows.withColumns({f"env_{k}": F.lit(v) for k, v in sorted(env.items())})


def results_sink(rows: DataFrame, env: Mapping[str, str], path: str, fmt: str = "csv") -> None:
    """Write result rows; an empty result is refused rather than written."""
    if rows.isEmpty():
        raise ValueError("no results to write")
    writer = with_environment(rows, env).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
