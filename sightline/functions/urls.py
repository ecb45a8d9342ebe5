"""URLs and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and MIME types that name a media kind.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
WEB_IMAGE_SUFFIXES = IMAGE_SUFFIXES + ["gif"]
VIDEO_SUFFIXES = ["mp4", "mov", "avi", "mkv", "webm", "m4v"]


def url_normalise(url: Column) -> Column:
    """The URL without fragment, or NULL unless it is http(s) with a host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    return F.when(bare.rlike(r"^(?i:https?)://[^/?#\s]+"), bare)


def url_origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def suffix_kind(path: Column, web: bool = False) -> Column:
    """``image``/``video`` by file suffix, NULL for anything else; the web also serves GIF photos."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(WEB_IMAGE_SUFFIXES if web else IMAGE_SUFFIXES), F.lit("image")).when(
        suffix.isin(VIDEO_SUFFIXES), F.lit("video"))


# MIME types of decodable media.
MEDIA_TYPES = {
    "image/jpeg": "image", "image/png": "image", "image/webp": "image", "image/bmp": "image",
    "image/gif": "image", "image/tiff": "image",
    "video/mp4": "video", "video/webm": "video", "video/quicktime": "video",
    "video/x-matroska": "video", "video/x-msvideo": "video", "video/x-m4v": "video",
}


def media_kind(url: Column, mime: Column | None = None) -> Column:
    """A known MIME type decides; a missing or opaque one leaves it to the suffix; others are no media."""
    by_suffix = suffix_kind(url_path(url), web=True)
    if mime is None:
        return by_suffix
    base = F.lower(F.trim(F.regexp_extract(mime, r"^([^;]*)", 1)))
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    opaque = mime.isNull() | (base == "") | (base == "application/octet-stream")
    return F.when(opaque, by_suffix).otherwise(F.try_element_at(known, base))
