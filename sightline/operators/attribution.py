"""Which registered asset does a file descend from: by bytes, by mark code, by perceptual hash.

``content(content_id, sha256, code, phash[, width, height])`` and
``assets(asset_id, user_id, sha256, phash, watermark_code, distribution_id, width, height)``.
Perceptual search compares distinct hash values only, so a third of all files sharing one hash costs
one comparison per registered hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashes import hash_words
from sightline.operators.blocks import BLOCK_ROWS, Merge, block_join, stripes
from sightline.operators.hash_index import nearest_by_radius
from sightline.settings import BASIS_CONFIDENCE, EVIDENCE_FLOOR

TILE_ROWS = 64  # hashes of one matrix of distances, which a core's cache holds
LOOK_UP = 16384  # comparisons of these tiles that one look-up of the radius search costs
FEW = 8  # so many least entries of a row are found one after the other

ASSET_FIELDS = ["asset_id", "user_id", "distribution_id", "watermark_code"]


def _first_asset(assets: DataFrame, key: str) -> DataFrame:
    """The smallest asset id per key value, as a struct; NULL keys never match."""
    fields = F.struct(*[c for c in ASSET_FIELDS if c in assets.columns])
    return assets.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(fields, "asset_id").alias("asset"))


def join_exact(content: DataFrame, assets: DataFrame) -> DataFrame:
    """Left join with the first asset of the same bytes (``exact`` struct)."""
    return content.join(_first_asset(assets, "sha256").withColumnRenamed("asset", "exact"), "sha256", "left")


def join_code(content: DataFrame, assets: DataFrame) -> DataFrame:
    """Left join with the first asset carrying the recovered mark code (``by_code`` struct)."""
    codes = _first_asset(assets, "watermark_code").select(
        F.col("watermark_code").alias("code"), F.col("asset").alias("by_code"))
    return content.join(codes, "code", "left")


def hash_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits between two sets of equally long hashes (rows of 64-bit words), in a byte where they fit."""
    total = np.bitwise_count(left[:, 0, None] ^ right[None, :, 0])
    if left.shape[1] > 3:
        total = total.astype(np.int16)
    for word in range(1, left.shape[1]):
        total += np.bitwise_count(left[:, word, None] ^ right[None, :, word])
    return total


def _words(frame: pd.DataFrame) -> np.ndarray:
    return np.vstack(frame["words"].to_numpy()).astype(np.int64).view(np.uint64)


def _distinct_hashes(df: DataFrame) -> DataFrame:
    return (df.where(F.col("phash").isNotNull() & (F.length("phash") > 0)).select("phash").distinct()
            .select("phash", F.length("phash").alias("digits"), hash_words(F.col("phash")).alias("words")))


def ranked_distances(distance: np.ndarray, rank: np.ndarray, ranks: int) -> np.ndarray:
    """Distances that sort by ``rank`` (below ``ranks``) where they are equal, in 32 bits if they fit."""
    kind = np.int32 if (int(distance.max(initial=0)) + 1) * ranks < 2 ** 31 else np.int64
    return distance.astype(kind) * kind(ranks) + rank.astype(kind)


def _least(distance: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` least entries of each row in order, ties by column, without sorting whole rows."""
    width = distance.shape[1]
    if k <= FEW:
        rows, columns = np.arange(len(distance)), []
        distance = distance.copy() if k > 1 else distance
        for _ in range(min(k, width)):
            columns.append(distance.argmin(axis=1))
            if k > 1:
                distance[rows, columns[-1]] = np.iinfo(distance.dtype).max
        return np.stack(columns, axis=1)
    ranked = ranked_distances(distance, np.arange(width), width)
    if k < width:
        ranked = np.partition(ranked, k - 1, axis=1)[:, :k]
    return np.sort(ranked, axis=1) % width


def farthest(bits: int, below: int | None, floor: float | None) -> int:
    """The largest distance that counts between hashes of so many bits; -1 if none does."""
    limit = bits - 1 if below is None else below
    return limit if floor is None else min(limit, int((1.0 - np.arange(bits + 1) / bits >= floor).sum()) - 1)


def _closest(k: int, below: int | None, floor: float | None):
    """Reducer of whole batches: the ``k`` nearest hashes of each, in tiles that a core's cache holds; rows without one that counts leave after a minimum."""

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["first_id", "phash"], kind="stable")
        a, b = _words(left), _words(right)
        limit = farthest(int(left["digits"].iloc[0]) * 4, below, floor)
        keys, other, firsts = left["phash"].to_numpy(), right["phash"].to_numpy(), right["first_id"].to_numpy()
        none, out = np.iinfo(np.int64).max, []
        for top in range(0, len(a), TILE_ROWS):
            lead = np.full((len(a[top:top + TILE_ROWS]), k), none)
            for at in range(0, len(b), BLOCK_ROWS):
                distance = hash_distances(a[top:top + TILE_ROWS], b[at:at + BLOCK_ROWS])
                rows = np.flatnonzero(distance.min(axis=1) <= limit)
                if not len(rows):
                    continue
                distance = distance[rows] if len(rows) < len(distance) else distance
                columns = _least(distance, k)
                found = np.take_along_axis(distance, columns, axis=1).astype(np.int64) * len(b) + at + columns
                lead[rows] = np.sort(np.concatenate([lead[rows], found], axis=1), axis=1)[:, :k]
            rows, at = np.nonzero(lead < (limit + 1) * len(b))
            d, columns = np.divmod(lead[rows, at], len(b))
            out.append(pd.DataFrame({"phash": keys[top + rows], "asset_phash": other[columns], "distance": d.astype(np.int32), "first_id": firsts[columns]}))
        return pd.concat(out)

    return reduce


def _merge_nearest(key: Sequence[str], order: Sequence[str], k: int) -> Merge:
    """The first ``k`` rows of each key, as the window over all cells would take them."""
    return lambda found: found.sort_values(list(order), kind="stable").groupby(list(key), sort=False).head(k)


def closest_hashes(content: DataFrame, assets: DataFrame, k: int = 1, below: int | None = None, cell_rows: int = BLOCK_ROWS, floor: float | None = None) -> DataFrame:
    """The ``k`` nearest registered hash values of each content hash: ``(phash, near array)``.

    Nearest first, ties by the smallest asset id; a hash differing in every bit never matches, and with a ``floor`` none of a lower similarity.
    """
    id_type = dict(assets.dtypes)["asset_id"]
    registered = (assets.where(F.col("phash").isNotNull() & (F.length("phash") > 0)).groupBy("phash").agg(F.min("asset_id").alias("first_id"))
                  .select("phash", F.col("phash").alias("asset_phash"), "first_id", F.length("phash").alias("digits"),
                          hash_words(F.col("phash")).alias("words")))

    def exhaustive(waiting: DataFrame, targets: DataFrame) -> DataFrame:
        cells = block_join(waiting, targets, ["phash"], ["phash"], _closest(k, below, floor),
                           f"phash string, asset_phash string, distance int, first_id {id_type}", same=["digits"], whole=True)
        order = Window.partitionBy("phash").orderBy("distance", "first_id", "asset_phash")
        top = cells.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)  # cut to k per task before the shuffle
        return top.groupBy("phash").agg(F.sort_array(F.collect_list(F.struct("distance", "first_id", "asset_phash"))).alias("near"))

    usable = None if floor is None else lambda target: similarity_of(F.col("distance"), F.col("phash")) >= floor
    return nearest_by_radius(_distinct_hashes(content), registered, ["phash"], ["asset_phash"], k, exhaustive, usable=usable, below=below,
                             cell_rows=cell_rows, look_up=LOOK_UP)


def similarity_of(distance: Column, phash: Column) -> Column:
    return F.lit(1.0) - distance / (F.length(phash) * 4)


def join_perceptual(content: DataFrame, assets: DataFrame) -> DataFrame:
    """Left join with the best-resembling asset, whatever its similarity (``by_hash``, ``best_similarity``)."""
    best = closest_hashes(content, assets, 1).select(
        "phash", F.col("near")[0]["asset_phash"].alias("asset_phash"), F.col("near")[0]["distance"].alias("d"))
    first = _first_asset(assets, "phash").withColumnRenamed("phash", "asset_phash").withColumnRenamed("asset", "by_hash")
    found = best.join(first, "asset_phash").select(
        "phash", "by_hash", similarity_of(F.col("d"), F.col("phash")).alias("best_similarity"))
    return content.join(found, "phash", "left")


def attribute_source(content: DataFrame, assets: DataFrame, floor: float = EVIDENCE_FLOOR) -> DataFrame:
    """Exact bytes outrank the mark code, the code outranks resemblance at or above ``floor``.

    ``perceptual_similarity`` is reported even when nothing matched; it is NULL only for an empty
    registry.
    """
    joined = join_perceptual(join_code(join_exact(content, assets), assets), assets)
    resembles = F.col("by_hash").isNotNull() & (F.col("best_similarity") >= floor)
    basis = (F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_code").isNotNull(), "code")
             .when(resembles, "perceptual"))
    chosen = (F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("by_code").isNotNull(), F.col("by_code"))
              .when(resembles, F.col("by_hash")))
    confidence = F.create_map(*[F.lit(x) for pair in BASIS_CONFIDENCE.items() for x in pair])
    empty = F.lit(assets.isEmpty())
    similarity = F.when(~empty, F.coalesce("best_similarity", F.lit(0.0)))
    kept = [c for c in content.columns if c not in ("phash",)]
    return joined.select(
        *kept, "phash", chosen["asset_id"].alias("asset_id"), chosen["user_id"].alias("asset_owner"),
        chosen["distribution_id"].alias("distribution_id"), basis.alias("basis"),
        F.try_element_at(confidence, basis).alias("confidence"), similarity.alias("perceptual_similarity"))


def closest_assets(content: DataFrame, assets: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` registered assets closest by perceptual hash, with an exact-bytes flag.

    Assets are numbered inside their hash value, at most ``n`` of each, so the join back to assets
    can only widen a content hash to ``n * n`` rows before the final cut.
    """
    near = closest_hashes(content, assets, n).select("phash", F.explode("near").alias("c"))
    inside = Window.partitionBy("phash").orderBy("asset_id")
    named = (assets.where(F.col("phash").isNotNull()).withColumn("rk", F.row_number().over(inside))
             .where(F.col("rk") <= n)
             .select(F.col("phash").alias("asset_phash"), "asset_id", F.col("sha256").alias("asset_sha256")))
    flat = near.select("phash", F.col("c.asset_phash").alias("asset_phash"), F.col("c.distance").alias("distance"))
    order = Window.partitionBy("phash").orderBy("distance", "asset_id")
    top = flat.join(named, "asset_phash").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return content.select("content_id", "sha256", "phash").join(top, "phash").select(
        "content_id", "rank", "asset_id", similarity_of(F.col("distance"), F.col("phash")).alias("similarity"),
        (F.col("sha256") == F.col("asset_sha256")).alias("exact"))


def is_restorable(width: Column, height: Column, asset_width: Column, asset_height: Column,
                  size_tolerance: float = 0.01, aspect_tolerance: float = 0.02) -> Column:
    """The copy is the registered picture at another scale: not the same size, but the same aspect."""
    same = ((F.abs(width - asset_width) <= size_tolerance * asset_width)
            & (F.abs(height - asset_height) <= size_tolerance * asset_height))
    aspect, target = width / height, asset_width / asset_height
    return ~same & (F.abs(aspect - target) <= aspect_tolerance * target)


def _sizes(floor: float, limit: int):
    none = np.iinfo(np.int64).max

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["width", "height", "first_id"], kind="stable")
        a, b = _words(left), _words(right)
        bits = int(left["digits"].iloc[0]) * 4
        w, h = right["width"].to_numpy(float), right["height"].to_numpy(float)
        bounds = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
        w, h = w[bounds], h[bounds]
        names, ranks = np.unique(right["first_id"].to_numpy(), return_inverse=True)
        out = []
        for part in stripes(len(left)):
            rows = left.iloc[part]
            distance = hash_distances(a[part], b)
            # of each asset size, the nearest hash and of equally near ones the first; then the nearest usable sizes
            nearest = np.minimum.reduceat(ranked_distances(distance, ranks, len(right)), bounds, axis=1).astype(np.int64)
            cw, ch = rows["width"].to_numpy(float)[:, None], rows["height"].to_numpy(float)[:, None]
            same = (np.abs(cw - w) <= 0.01 * w) & (np.abs(ch - h) <= 0.01 * h)
            usable = ~same & (np.abs(cw / ch - w / h) <= 0.02 * (w / h)) & (1.0 - nearest // len(right) / bits >= floor)
            nearest = np.where(usable, nearest, none)
            lead = np.argsort(nearest, axis=1, kind="stable")[:, :limit]
            best = np.take_along_axis(nearest, lead, axis=1)
            i, at = np.nonzero(best < none)
            size, d = lead[i, at], best[i, at] // len(right)
            out.append(pd.DataFrame({"phash": rows["phash"].to_numpy()[i], "width": rows["width"].to_numpy()[i], "height": rows["height"].to_numpy()[i],
                                     "asset_width": w[size].astype(np.int64), "asset_height": h[size].astype(np.int64), "distance": d.astype(np.int32),
                                     "first_id": names[best[i, at] % len(right)]}))
        return pd.concat(out)

    return reduce


def restore_sizes(content: DataFrame, assets: DataFrame, floor: float = EVIDENCE_FLOOR, limit: int = 3, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """Registered sizes worth retrying per copy, in order of resemblance, at most ``limit`` distinct ones."""
    id_type = dict(assets.dtypes)["asset_id"]
    shapes = content.select("phash", "width", "height").distinct().withColumns(
        {"digits": F.length("phash"), "words": hash_words(F.col("phash"))})
    known = assets.where(F.col("width").isNotNull() & F.col("height").isNotNull())
    sizes = known.groupBy("phash", "width", "height").agg(F.min("asset_id").alias("first_id")).withColumns(
        {"digits": F.length("phash"), "words": hash_words(F.col("phash"))})
    key, label = ["phash", "width", "height"], ["asset_width", "asset_height"]

    one_a_size, nearest = (_merge_nearest(group, ["distance", "first_id", *label], most) for group, most in ((key + label, 1), (key, limit)))

    def exhaustive(waiting: DataFrame, targets: DataFrame) -> DataFrame:
        cells = block_join(
            waiting, targets, key, ["phash", "width", "height"], _sizes(floor, limit),
            f"phash string, width int, height int, asset_width int, asset_height int, distance int, first_id {id_type}", same=["digits"],
            merge=lambda found: nearest(one_a_size(found)))
        best = cells.groupBy(*key, *label).agg(F.min(F.struct("distance", "first_id")).alias("m"))
        order = Window.partitionBy(*key).orderBy("m", *label)
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("m.distance", "m.first_id", *label))).alias("near"))

    usable = lambda target: (is_restorable(F.col("width"), F.col("height"), target["asset_width"], target["asset_height"])
                             & (similarity_of(F.col("distance"), F.col("phash")) >= floor))
    sizes = sizes.select("phash", "width", "height", F.col("width").alias("asset_width"), F.col("height").alias("asset_height"), "first_id", "digits", "words")
    near = nearest_by_radius(shapes, sizes, key, label, limit, exhaustive, usable=usable, cell_rows=cell_rows)
    ranked = near.select(*key, F.posexplode("near").alias("at", "n")).select(*key, (F.col("at") + 1).alias("rank"), "n.asset_width", "n.asset_height")
    return content.select("content_id", "phash", "width", "height").join(ranked, ["phash", "width", "height"]).select(
        "content_id", "rank", "asset_width", "asset_height")


def compare_fingerprints(pairs: DataFrame) -> DataFrame:
    """Add exact flag and both hash distances/similarities to ``(left_*, right_*)`` fingerprint pairs."""
    from sightline.functions.hashes import hamming, hash_similarity
    out = pairs.withColumn("sha256_match", (F.col("left_sha256") == F.col("right_sha256")).cast("double"))
    for family in ("phash", "dhash"):
        a, b = F.col(f"left_{family}"), F.col(f"right_{family}")
        out = out.withColumn(f"{family}_hamming", hamming(a, b)).withColumn(f"{family}_similarity", hash_similarity(a, b))
    if "left_vector" in pairs.columns:
        from sightline.functions.vectors import cosine_similarity
        both = F.col("left_vector").isNotNull() & F.col("right_vector").isNotNull()
        out = out.withColumn("semantic_similarity", F.when(
            both, cosine_similarity(F.col("left_vector"), F.col("right_vector"))))
    return out


def dedupe_by_content(items: DataFrame, uri: str = "uri", ord: str = "ord") -> DataFrame:
    """One row per sha256: the first URI, how many others, and a digest of all of them in order.

    A popular file may be at a third of all places, so its URIs are counted, never gathered; the full
    list stays available as rows through :func:`also_at`.
    """
    return items.groupBy("sha256").agg(F.min_by(uri, ord).alias("uri"), F.count("*").alias("copies"))


def also_at(items: DataFrame, uri: str = "uri", ord: str = "ord") -> DataFrame:
    """Every further place of each file, as rows ``(sha256, uri, ord)``."""
    first = items.groupBy("sha256").agg(F.min(ord).alias("__first"))
    return items.join(first, "sha256").where(F.col(ord) > F.col("__first")).select("sha256", uri, ord)


def leakage_check(training: DataFrame, manifest: DataFrame, parts: int = 2) -> DataFrame:
    """Evaluated items a detector was trained on: ``(detector, item, basis)``.

    By content hash, else by the last ``parts`` components of the normalised path.
    """
    suffix = lambda c: F.regexp_extract(F.lower(F.regexp_replace(c, r"\\\\", "/")), rf"((?:[^/]+/){{{parts - 1}}}[^/]+)$", 1)
    t = training.select("detector", "sha256", suffix(F.col("path")).alias("tail"))
    by_hash = manifest.join(t.select("detector", "sha256").distinct(), "sha256").select(
        "detector", "item", F.lit("content").alias("basis"))
    m = manifest.select("item", suffix(F.col("path")).alias("tail")).where(F.col("tail") != "")
    by_path = m.join(t.select("detector", "tail").distinct(), "tail").select("detector", "item", F.lit("path").alias("basis"))
    return by_hash.unionByName(by_path).groupBy("detector", "item").agg(F.min("basis").alias("basis"))
