"""Queries on identities: templates, matching, leave-one-out, aliases, cohorts, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import UNIT, photos, probes, references
from sightline.functions import vectors as V
from sightline.operators import matching as M
from sightline.session import table

r6 = lambda name: F.round(name, 6).alias(name)


def identity_templates(spark: SparkSession, sf: str) -> DataFrame:
    built = M.build_templates(references(spark, sf))
    return built.select("user_id", "image_count", "dim", F.posexplode("centroid").alias("pos", "value")).select(
        "user_id", "image_count", "dim", "pos", r6("value"))


def embedding_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Digest-only view of every vector (six decimals, as logged), checked against its own rule."""
    return photos(spark, sf).select(
        "name", F.size("vector").alias("dim"),
        F.round(V.norm(F.col("vector")), 6).alias("norm"),
        F.length(V.redacted(F.col("vector"))["digest"]).alias("digest_chars"))


def match_decisions(spark: SparkSession, sf: str) -> DataFrame:
    scores = M.identity_scores(probes(spark, sf), references(spark, sf), exclude_self=True)
    return M.rank_identities(scores).select(
        "probe_id", "user_id", r6("similarity"), r6("runner_up"), r6("margin"), r6("euclidean"), "decision")


def match_decisions_by_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As match_decisions, with references cut into blocks by direction and most cells ruled out by their bounds."""
    scores = M.identity_scores(probes(spark, sf), references(spark, sf), exclude_self=True, block_rows=128)
    return M.rank_identities(scores).select(
        "probe_id", "user_id", r6("similarity"), r6("runner_up"), r6("margin"), r6("euclidean"), "decision")


def _match(strategy: str, exclude_self: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scores = M.identity_scores(probes(spark, sf), references(spark, sf), strategy, 3, exclude_self)
        return M.rank_identities(scores).select(
            "probe_id", "user_id", r6("similarity"), r6("margin"), "decision")

    return run


def leave_one_out_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.leave_one_out(photos(spark, sf)).select(
        "probe_id", "own", r6("genuine"), r6("impostor"), "impostor_id")


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.pair_score_counts(photos(spark, sf), 4)


def identity_score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return M.identity_score_counts(photos(spark, sf), 4)


def swap_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding is a fake: its label the donor, the next label the target."""
    fakes = probes(spark, sf).select(
        "probe_id", "vector", "dim", F.col("own").alias("donor"),
        ((F.col("own") + 1) % 10).alias("target"), F.col("probe_id").alias("source_name"))
    return M.swap_roles(fakes, references(spark, sf)).select(
        "probe_id", r6("donor_score"), r6("target_score"), r6("other_score"), "top_role")


def cohort_normalised_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The photos of the two last identities are the cohort."""
    cohort = photos(spark, sf).where("identity >= 8").select(
        F.col("name").alias("cohort_id"), "vector", F.size("vector").alias("dim"))
    offset = M.cohort_offset(probes(spark, sf), cohort, 5)
    scores = M.leave_one_out(photos(spark, sf)).select("probe_id", "genuine", "impostor")
    return scores.join(offset, "probe_id").select(
        "probe_id", r6("offset"), F.round(F.col("genuine") - F.col("offset"), 6).alias("genuine"),
        F.round(F.col("impostor") - F.col("offset"), 6).alias("impostor"))


def fused_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The two halves of the vector as two recognisers."""
    def half(start: int) -> DataFrame:
        cut = photos(spark, sf).withColumn("vector", F.slice("vector", start, 32))
        side = cut.select(F.col("name").alias("probe_id"), F.col("identity").alias("own"), "vector",
                          F.size("vector").alias("dim"))
        refs = cut.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"),
                          F.col("name").alias("ref_name"), "vector", F.size("vector").alias("dim"))
        return M.identity_maxima(side, refs).select(
            "probe_id", "user_id", F.col("similarity").alias("score"),
            (F.col("own") == F.col("user_id")).cast("int").alias("label"))

    return M.fuse_scores(half(1), half(33)).select("probe_id", "user_id", "label", r6("score"))


def alias_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return M.alias_pairs(photos(spark, sf), 0.35)


def enrollment_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as enrolment photos of their source, length as sharpness."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("user_id"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("image_id"),
        (F.col("lang") != "xx").alias("readable"),
        (F.lit(0.6) + (F.length("source") % 5) * 0.1).alias("confidence"),
        (F.lit(60) + F.col("n_chars") % 97).alias("face_pixels"), F.col("n_chars").cast("double").alias("sharpness"))
    return M.filter_enrollment(docs)


QUERIES = {
    "identity_templates": identity_templates,
    "embedding_redaction": embedding_redaction,
    "match_decisions": match_decisions,
    "match_decisions_by_blocks": match_decisions_by_blocks,
    "match_topk_mean": _match("topk_mean", True),
    "match_centroid": _match("centroid", False),
    "match_mean": _match("mean", False),
    "leave_one_out_scores": leave_one_out_scores,
    "pair_scores": pair_scores,
    "identity_score_distribution": identity_score_distribution,
    "swap_roles": swap_roles,
    "cohort_normalised_scores": cohort_normalised_scores,
    "fused_scores": fused_scores,
    "alias_exclusions": alias_exclusions,
    "enrollment_filter": enrollment_filter,
}

# Per-probe identity scores by different rules, all as p(probe_id, user_id, similarity, euclidean).
_PAIRS = f"""{UNIT}, pairs AS (SELECT a.vec_id AS probe_id, a.label AS own, b.label AS user_id, b.vec_id AS ref,
  list_dot_product(a.v, b.v) AS c, list_distance(a.raw, b.raw) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id)"""
_MAX = f"""{_PAIRS}, p AS (SELECT probe_id, own, user_id, max(c) AS similarity, min(d) AS euclidean
  FROM pairs GROUP BY ALL)"""
_TOPK = f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY probe_id, user_id ORDER BY c DESC) AS rk
  FROM pairs), p AS (SELECT probe_id, user_id, avg(c) AS similarity, 0.0 AS euclidean FROM k WHERE rk <= 3
  GROUP BY ALL)"""
_MEAN = f"""{UNIT}, p AS (SELECT a.vec_id AS probe_id, b.label AS user_id, avg(list_dot_product(a.v, b.v))
  AS similarity, 0.0 AS euclidean FROM u a, u b GROUP BY ALL)"""
_TEMPLATE = f"""{UNIT}, x AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(v) AS val FROM u),
  m AS (SELECT label, pos, avg(val) AS mv, count(*) AS n FROM x GROUP BY ALL),
  c AS (SELECT label, max(n) AS n, list(mv ORDER BY pos) AS raw FROM m GROUP BY label),
  t AS (SELECT label, n, list_transform(raw, lambda y: y / greatest(sqrt(list_dot_product(raw, raw)), 1e-12)) AS v
  FROM c)"""
_CENTROID = f"""{_TEMPLATE}, p AS (SELECT u.vec_id AS probe_id, t.label AS user_id,
  list_dot_product(u.v, t.v) AS similarity, 0.0 AS euclidean FROM u, t)"""
_RANK = """, w AS (SELECT *, row_number() OVER q AS rn, lead(similarity) OVER q AS runner_up FROM p
  WINDOW q AS (PARTITION BY probe_id ORDER BY similarity DESC, user_id)),
  best AS (SELECT *, similarity - runner_up AS margin,
  coalesce(similarity - runner_up < 0.05, false) AS demoted FROM w WHERE rn = 1),
  ruled AS (SELECT *, CASE WHEN demoted AND similarity >= 0.3591 THEN 'ambiguous'
  WHEN similarity >= 0.47 AND NOT demoted THEN 'high_confidence'
  WHEN similarity >= 0.3591 THEN 'candidate' ELSE 'no_match' END AS decision FROM best)"""


def _ranked(scores: str) -> str:
    return (f"WITH {scores}{_RANK} SELECT probe_id, user_id, round(similarity, 6) AS similarity, "
            "round(margin, 6) AS margin, decision FROM ruled")


_LOO = f"""{_MAX}, best AS (SELECT probe_id, any_value(own) AS own, max(CASE WHEN own = user_id THEN similarity END)
  AS genuine, max(CASE WHEN own <> user_id THEN similarity END) AS impostor,
  arg_max(user_id, CASE WHEN own <> user_id THEN similarity END) AS impostor_id FROM p GROUP BY probe_id)"""

ORACLES = {
    "identity_templates": f"""WITH {_TEMPLATE} SELECT label AS user_id, n AS image_count, 64 AS dim,
      unnest(range(0, 64)) AS pos, round(unnest(v), 6) AS value FROM t""",
    "embedding_redaction": """SELECT vec_id AS name, len(embedding) AS dim,
      round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 12 AS digest_chars
      FROM embeddings""",
    "match_decisions": f"""WITH {_MAX}{_RANK} SELECT probe_id, user_id, round(similarity, 6) AS similarity,
      round(runner_up, 6) AS runner_up, round(margin, 6) AS margin, round(euclidean, 6) AS euclidean, decision
      FROM ruled""",
    "match_decisions_by_blocks": f"""WITH {_MAX}{_RANK} SELECT probe_id, user_id, round(similarity, 6) AS similarity,
      round(runner_up, 6) AS runner_up, round(margin, 6) AS margin, round(euclidean, 6) AS euclidean, decision
      FROM ruled""",
    "match_topk_mean": _ranked(_TOPK),
    "match_centroid": _ranked(_CENTROID),
    "match_mean": _ranked(_MEAN),
    "leave_one_out_scores": f"""WITH {_LOO} SELECT probe_id, own, round(genuine, 6) AS genuine,
      round(impostor, 6) AS impostor, impostor_id FROM best""",
    "pair_scores": f"""WITH {UNIT}, p AS (SELECT (a.label = b.label)::INT AS label,
      round(list_dot_product(a.v, b.v) * 1e4)::BIGINT AS step FROM u a JOIN u b ON a.vec_id < b.vec_id)
      SELECT label, step / 10000 AS score, count(*) AS n FROM p GROUP BY label, step""",
    "identity_score_distribution": f"""WITH {_MAX} SELECT (own = user_id)::INT AS label,
      round(similarity * 1e4)::BIGINT / 10000 AS score, count(*) AS n FROM p GROUP BY 1, 2""",
    "swap_roles": f"""WITH {_MAX}, r AS (SELECT probe_id,
      max(CASE WHEN user_id = own THEN similarity END) AS donor_score,
      max(CASE WHEN user_id = (own + 1) % 10 THEN similarity END) AS target_score,
      max(CASE WHEN user_id <> own AND user_id <> (own + 1) % 10 THEN similarity END) AS other_score
      FROM p GROUP BY probe_id)
      SELECT probe_id, round(donor_score, 6) AS donor_score, round(target_score, 6) AS target_score,
      round(other_score, 6) AS other_score, CASE greatest(donor_score, target_score, other_score)
      WHEN donor_score THEN 'donor' WHEN target_score THEN 'target' ELSE 'other' END AS top_role FROM r""",
    "cohort_normalised_scores": f"""WITH {_LOO}, k AS (SELECT a.vec_id AS probe_id, list_dot_product(a.v, b.v) AS c,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rk
      FROM u a JOIN u b ON b.label >= 8), o AS (SELECT probe_id, avg(c) AS shift FROM k WHERE rk <= 5 GROUP BY 1)
      SELECT probe_id, round(shift, 6) AS "offset", round(genuine - shift, 6) AS genuine,
      round(impostor - shift, 6) AS impostor FROM best JOIN o USING (probe_id)""",
    "fused_scores": """WITH h AS (SELECT vec_id, label, s, list_slice(embedding::DOUBLE[], s, s + 31) AS w
      FROM embeddings, (VALUES (1), (33)) t(s)), u AS (SELECT vec_id, label, s, list_transform(w, lambda x:
      x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS v FROM h),
      p AS (SELECT a.vec_id AS probe_id, b.label AS user_id, (a.label = b.label)::INT AS label, a.s,
      max(list_dot_product(a.v, b.v)) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.s = b.s GROUP BY ALL)
      SELECT probe_id, user_id, label, round(avg(c), 6) AS score FROM p GROUP BY ALL""",
    "alias_exclusions": f"""WITH {_MAX} SELECT probe_id, own, user_id FROM p WHERE own <> user_id
      AND similarity > 0.35""",
    "enrollment_filter": """WITH c AS (SELECT source AS user_id, doc_id AS ord, doc_id AS image_id,
      lang <> 'xx' AS readable, 0.6 + (length(source) % 5) * 0.1::DOUBLE AS confidence,
      60 + n_chars % 97 AS face_pixels, n_chars::DOUBLE AS sharpness,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
      j AS (SELECT * EXCLUDE rn, CASE WHEN NOT readable THEN 'unreadable' WHEN confidence < 0.7 THEN 'low_confidence'
      WHEN face_pixels < 80 THEN 'small_face' WHEN sharpness < 100 THEN 'blurred' END AS reason FROM c WHERE rn <= 10),
      m AS (SELECT *, quantile_cont(CASE WHEN reason IS NULL THEN sharpness END, 0.5)
      OVER (PARTITION BY user_id) * 0.15 AS floor FROM j),
      f AS (SELECT * EXCLUDE (reason, floor), CASE WHEN reason IS NULL AND sharpness < floor THEN 'blurrier_than_batch'
      ELSE reason END AS reason FROM m)
      SELECT *, count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY user_id) >= 3 AS enrolled FROM f""",
}
