"""The full evidence record per image: independent joins, a gate before the scorer, one verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.quality import effective_thresholds
from sightline.operators.attribution import attribute_source
from sightline.operators.facecheck import registered_face_check
from sightline.operators.matching import claimed_scores, identity_scores, rank_identities
from sightline.plans import verdicts as V
from sightline.session import cut_lineage
from sightline.settings import FaceThresholds, ScoreThresholds


def _face_id():
    return F.concat_ws("#", F.col("content_id"), F.col("face_ix"))


def best_faces(ranked: DataFrame) -> DataFrame:
    """Best face per content: ``(content_id, best_user, best_similarity, best_decision, ...)``."""
    top = F.max_by(F.struct("user_id", "similarity", "decision", "is_candidate", "is_high", "margin", "face_ix"),
                   F.struct("similarity", -F.col("face_ix")))
    return ranked.groupBy("content_id").agg(top.alias("b")).select(
        "content_id", F.col("b.user_id").alias("best_user"), F.col("b.similarity").alias("best_similarity"),
        F.col("b.decision").alias("best_decision"), F.col("b.is_candidate").alias("best_candidate"),
        F.col("b.is_high").alias("best_high"), F.col("b.margin").alias("best_margin"), F.col("b.face_ix").alias("best_face"))


def analyze_images(content: DataFrame, faces: DataFrame, assets: DataFrame, registered_faces: DataFrame, references: DataFrame,
                   scorer: Callable[[DataFrame], DataFrame] | None = None, limits: FaceThresholds = FaceThresholds(),
                   score_limits: ScoreThresholds = ScoreThresholds(), strategy: str = "max", k: int = 3) -> DataFrame:
    """Evidence and verdict per content row. ``strategy`` and ``k`` are those of ``identity_scores``.

    ``content(content_id, sha256, code, phash, width, height)``, ``faces(content_id, face_ix, vector, dim, pixels,
    quality, bbox, change_ratio)``, ``registered_faces`` as in the face check plus ``user_id``. ``scorer`` turns the
    gated ``(content_id, face_ix, vector)`` rows into ``(content_id, deepfake_score)``; nothing else is scored.
    """
    # What is given is read several times and may be dear to make, hashes above all.
    assets = cut_lineage(assets.select("asset_id", "user_id", "sha256", "phash", "watermark_code", "distribution_id", "width", "height", "shielded"))
    content = cut_lineage(content)
    origin = cut_lineage(attribute_source(content, assets).join(
        assets.select("asset_id", "shielded", F.col("width").alias("asset_width"), F.col("height").alias("asset_height")),
        "asset_id", "left"))
    counted = faces.groupBy("content_id").agg(F.count("*").alias("faces_detected"))

    # One comparison of faces with identities serves ranking and the asset owner's claim alike.
    probes = faces.withColumn("probe_id", _face_id()).join(
        origin.select("content_id", F.col("asset_owner").alias("claim")), "content_id", "left")
    scores = cut_lineage(identity_scores(probes, references, strategy, k))
    places = probes.select("probe_id", "content_id", "face_ix", "quality")
    ranked = rank_identities(scores.join(places.select("probe_id", "quality"), "probe_id"), limits, F.col("quality")).join(
        places.drop("quality"), "probe_id")
    best = best_faces(ranked)
    base = origin.join(counted, "content_id", "left").join(best, "content_id", "left").withColumn(
        "subject_user_id", V.resolve_subject(F.lit(None).cast("string"), F.col("asset_owner"), F.col("best_user"),
                                             F.col("best_decision")))
    base = cut_lineage(base)

    subject_of = base.select("content_id", "subject_user_id", "asset_id", "basis", "shielded")
    detail = faces.withColumn("probe_id", _face_id()).join(subject_of, "content_id")
    scored = claimed_scores(scores, detail.select("probe_id", F.col("subject_user_id").alias("claim")))
    candidate_at, high_at = effective_thresholds(F.col("quality"), limits)
    decision = V.subject_decision(F.col("own_score"), F.col("impostor"), F.col("subject_user_id") < F.col("impostor_id"),
                                  candidate_at, high_at, limits.min_margin)
    judged = detail.join(scored, "probe_id", "left")
    subject = V.subject_result(judged.select(
        "content_id", "face_ix", F.col("own_score").alias("similarity"), decision.alias("decision"),
        F.col("pixels").alias("subject_pixels"), F.col("quality").alias("subject_quality"))).withColumnsRenamed(
        {"similarity": "subject_similarity", "decision": "subject_decision"}).drop("face_ix")
    base = base.join(subject, "content_id", "left")

    # Only copies of an own asset whose owner is not plainly visible are compared with the registered file.
    open_cases = base.where(F.col("asset_id").isNotNull() & (F.col("asset_owner") == F.col("subject_user_id"))
                            & (F.col("basis") != "exact")
                            & ~F.col("subject_decision").eqNullSafe("high_confidence")).select("content_id")
    sizes = content.select("content_id", "width", "height")
    doubtful = judged.join(open_cases, "content_id", "left_semi").join(sizes, "content_id")
    owners = registered_faces.withColumn("probe_id", F.concat_ws("#", "asset_id", "face_ix")).withColumn(
        "claim", F.when(~F.col("shielded"), F.col("user_id"))).where("claim IS NOT NULL")
    own_reg = claimed_scores(identity_scores(owners, references, strategy, k), owners).select("probe_id", "own_score")
    registered = registered_faces.withColumn("probe_id", F.concat_ws("#", "asset_id", "face_ix")).join(
        own_reg, "probe_id", "left")
    check = registered_face_check(doubtful, registered, limits).drop("asset_id")
    base = base.join(check, "content_id", "left")

    if scorer is not None:
        gated = faces.join(best.where("best_candidate").select("content_id", F.col("best_face").alias("face_ix")),
                           ["content_id", "face_ix"], "left_semi")
        base = base.join(scorer(gated), "content_id", "left")
    else:
        base = base.withColumn("deepfake_score", F.lit(None).cast("double"))
    enrolled = F.lit(not references.isEmpty())
    found = F.coalesce("faces_detected", F.lit(0)).cast("int")
    compared = enrolled & ((found == 0) | F.col("best_similarity").isNotNull())
    evidence = base.select(
        "content_id", "sha256", F.lit("image").alias("media_type"), "subject_user_id", compared.alias("identities_compared"),
        found.alias("faces_detected"),
        F.coalesce("subject_decision", F.when(compared & F.col("best_similarity").isNotNull(), "no_match")).alias("identity_decision_subject"),
        F.col("subject_similarity").alias("identity_similarity"), F.col("subject_quality").alias("probe_quality"),
        F.col("subject_pixels").alias("probe_face_pixels"),
        V.copy_scale(F.col("face_scale"), F.col("width"), F.col("height"), F.col("asset_width"), F.col("asset_height")).alias("copy_scale"),
        F.col("asset_id").cast("string").alias("asset_id"), "asset_owner", F.col("basis").alias("asset_match_basis"), "distribution_id",
        "owner_face_in_original", F.coalesce("shielded", F.lit(False)).alias("asset_shielded"),
        F.coalesce("compared", F.lit(False)).alias("registered_faces_compared"), "owner_face_kept",
        F.col("faces_kept").alias("face_in_registered_file"), "replaced_face_pixels",
        F.coalesce("faces_degraded", F.lit(0)).cast("int").alias("degraded_faces"),
        F.when(F.col("best_user") == F.col("subject_user_id"), F.col("deepfake_score")).alias("deepfake_score"),
        F.lit(score_limits.calibrated).alias("deepfake_calibrated"), F.col("best_similarity").alias("face_similarity"),
        F.when(F.col("best_high"), F.col("best_user")).alias("matched_user_id"), F.coalesce("best_decision", F.lit("no_match")).alias("best_decision"),
        F.col("code").isNotNull().alias("watermark_detected"), F.col("code").alias("watermark_code"), "perceptual_similarity", "confidence")
    judged_rows = V.assess(evidence.withColumnRenamed("identity_decision_subject", "identity_decision"), score_limits)
    shown = judged_rows.withColumns({"subject_decision": F.col("identity_decision"), "identity_decision": F.col("best_decision")})
    return shown.withColumn("summary", V.summarize()).drop("best_decision")
