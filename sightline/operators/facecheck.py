"""Faces of a copy against the faces of the registered file it descends from.

``copy_faces(content_id, asset_id, face_ix, vector, dim, pixels, bbox, width, height, own_score,
change_ratio, shielded)`` and ``registered_faces(asset_id, face_ix, vector, pixels, bbox, width, height,
own_score)``. A file shows at most the detector's face limit, so one join on the asset compares at
most that many pairs per copy face; a much-copied asset is a skewed equi-join, split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.boxes import centre_distance
from sightline.functions.vectors import cosine_similarity
from sightline.operators.matching import decision_of, decision_rank
from sightline.settings import FACE_CHANGE_RATIO, FaceThresholds

ALIGNED_SLACK = 2  # pixels a video codec may trim


def is_aligned(width: Column, height: Column, asset_width: Column, asset_height: Column) -> Column:
    return (F.abs(width - asset_width) <= ALIGNED_SLACK) & (F.abs(height - asset_height) <= ALIGNED_SLACK)


def nearest_by_centre(faces: DataFrame, candidates: DataFrame, on: str = "asset_id") -> DataFrame:
    """Candidate face whose centre, relative to its canvas, is closest to each face's."""
    other = candidates.select(on, F.col("face_ix").alias("near_ix"), F.col("bbox").alias("nbox"), F.col("width").alias("nw"),
                              F.col("height").alias("nh"), F.col("pixels").alias("near_pixels"))
    distance = centre_distance(F.col("bbox"), F.col("width"), F.col("height"), F.col("nbox"), F.col("nw"), F.col("nh"))
    keys = ["content_id", "face_ix"]
    return (faces.join(other, on).groupBy(*keys)
            .agg(F.min(F.struct(distance.alias("distance"), "near_ix", "near_pixels")).alias("m")).select(*keys, "m.*"))


def compare_faces(copy_faces: DataFrame, registered_faces: DataFrame, limits: FaceThresholds = FaceThresholds()) -> DataFrame:
    """Class of each copy face: ``kept``, ``weak``, ``degraded`` or ``replaced``."""
    reg = registered_faces.select("asset_id", F.col("face_ix").alias("reg_ix"), F.col("vector").alias("reg_vector"),
                                  F.col("pixels").alias("reg_pixels"), F.col("width").alias("reg_width"),
                                  F.col("height").alias("reg_height"))
    scored = copy_faces.join(reg, "asset_id").withColumn("sim", cosine_similarity(F.col("vector"), F.col("reg_vector")))
    entry = F.struct((-F.col("sim")).alias("loss"), "reg_ix", "reg_pixels")
    keys = ["content_id", "asset_id", "face_ix"]
    kept = ["pixels", "bbox", "width", "height", "own_score", "change_ratio", "shielded"]
    top = scored.groupBy(*keys).agg(
        F.min(entry).alias("best"), F.slice(F.sort_array(F.collect_list(-F.col("sim"))), 1, 2).alias("losses"),
        F.first("reg_width").alias("reg_width"), F.first("reg_height").alias("reg_height"),
        *[F.first(c).alias(c) for c in kept])
    sim, runner = -F.col("best.loss"), -F.get("losses", 1)
    close = F.coalesce(sim - runner < limits.min_margin, F.lit(False))
    decision = (F.when(close & (sim >= limits.candidate), "ambiguous")
                .when(~close & (sim >= limits.high), "high_confidence")
                .when(sim >= limits.candidate, "candidate").otherwise("no_match"))
    aligned = is_aligned(F.col("width"), F.col("height"), F.col("reg_width"), F.col("reg_height"))
    owner_like = ~F.col("shielded") & F.coalesce(decision_of(F.col("own_score"), limits) != "no_match", F.lit(False)) & F.col("own_score").isNotNull()
    klass = (F.when(decision == "high_confidence", "kept").when(decision != "no_match", "weak").when(owner_like, "weak")
             .when(aligned & F.coalesce(F.col("change_ratio") < FACE_CHANGE_RATIO, F.lit(False)), "degraded").otherwise("replaced"))
    return top.select(*keys, *kept, aligned.alias("aligned"), sim.alias("similarity"), decision.alias("decision"),
                      klass.alias("klass"), F.col("best.reg_ix").alias("reg_ix"), F.col("best.reg_pixels").alias("reg_pixels"))


def owner_in_file(registered_faces: DataFrame, limits: FaceThresholds = FaceThresholds()) -> DataFrame:
    """Whether each registered file shows its owner (NULL = borderline, or shielded), and on which face."""
    decision = decision_of(F.col("own_score"), limits)
    order = F.struct(decision_rank(decision).alias("r"), "own_score", (-F.col("face_ix")).alias("first"))
    best = registered_faces.groupBy("asset_id").agg(
        F.max_by(F.struct(decision.alias("decision"), "face_ix"), F.when(F.col("own_score").isNotNull(), order)).alias("b"),
        F.count("own_score").alias("compared"))
    d = F.when(F.col("compared") > 0, F.col("b.decision"))
    shown = F.when(d.isNull() | (d == "no_match"), F.lit(False)).when(d == "high_confidence", F.lit(True))
    return best.select("asset_id", shown.alias("owner_shown"),
                       F.when(d == "high_confidence", F.col("b.face_ix")).alias("owner_ix"))


def registered_face_check(copy_faces: DataFrame, registered_faces: DataFrame,
                          limits: FaceThresholds = FaceThresholds()) -> DataFrame:
    """Per copy: owner shown / kept, faces kept (tri-state), largest replaced face, scale, degraded faces."""
    faces = compare_faces(copy_faces, registered_faces, limits)
    near = nearest_by_centre(copy_faces, registered_faces).select("content_id", "face_ix", "near_pixels")
    faces = faces.join(near, ["content_id", "face_ix"], "left").join(owner_in_file(registered_faces, limits), "asset_id", "left")
    is_ = lambda k: F.col("klass") == k
    largest = F.max_by(F.struct("pixels", "near_pixels"), F.when(is_("replaced"), F.struct("pixels", -F.col("face_ix"))))
    out = faces.groupBy("content_id", "asset_id").agg(
        F.first("shielded").alias("shielded"), F.first("aligned").alias("aligned"), F.first("owner_shown").alias("owner_shown"),
        F.first("owner_ix").alias("owner_ix"),
        F.bool_or(is_("kept") & (F.col("reg_ix") == F.col("owner_ix"))).alias("kept_owner"),
        F.count_if(is_("replaced")).alias("replaced"), F.count_if(is_("weak")).alias("weak"),
        F.count_if(is_("degraded")).alias("degraded"), largest.alias("big"),
        F.percentile(F.when(is_("kept"), F.col("pixels") / F.col("reg_pixels")), F.lit(0.5)).alias("kept_ratio"))
    has = F.col("replaced") > 0
    scale = F.coalesce("kept_ratio", F.when(F.col("aligned"), F.lit(1.0)),
                       F.when(has, F.col("big.pixels") / F.col("big.near_pixels")))
    known = ~F.col("shielded")
    return out.select(
        "content_id", "asset_id", F.lit(True).alias("compared"), F.when(known, F.col("owner_shown")).alias("owner_face_in_original"),
        F.when(known & F.col("owner_ix").isNotNull(), F.coalesce("kept_owner", F.lit(False))).alias("owner_face_kept"),
        F.when(has, F.lit(False)).when((F.col("weak") == 0) & (F.col("degraded") == 0), F.lit(True)).alias("faces_kept"),
        F.when(has, F.col("big.pixels")).alias("replaced_face_pixels"), F.round(scale, 4).alias("face_scale"),
        F.col("degraded").alias("faces_degraded"))
