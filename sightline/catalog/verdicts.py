"""Queries on verdicts, scans and the registered-face check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.identity import _MAX
from sightline.catalog.inputs import HASHES, UNIT, assets, copies, planes, probes, references
from sightline.functions.boxes import make_box
from sightline.operators import attribution as A
from sightline.operators import facecheck as FC
from sightline.operators import matching as M
from sightline.plans import images, scan
from sightline.plans import verdicts as V
from sightline.session import cut_lineage, table

r6 = lambda name: F.round(name, 6).alias(name)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Copies with their attribution and their leave-one-out identity match; the tri-state signals of the
    registered-face check are derived from the id so that every combination occurs."""
    c = F.col("content_id")
    origin = cut_lineage(A.attribute_source(copies(spark, sf), assets(spark, sf)).select(
        "content_id", "asset_id", "asset_owner", "distribution_id", "basis", "width", "code",
        (200 + (F.col("asset_id") % 5) * 40).alias("asset_width"),
        F.substring("asset_owner", 6, 10).cast("int").alias("claim")))
    sides = probes(spark, sf).join(origin.select(c.alias("probe_id"), "claim"), "probe_id", "left")
    scores = cut_lineage(M.identity_scores(sides, references(spark, sf), exclude_self=True))
    best = M.rank_identities(scores).select(
        F.col("probe_id").alias("content_id"), F.col("user_id").alias("best_label"), F.col("similarity").alias("best_similarity"),
        F.col("decision").alias("best_decision"), F.col("is_high").alias("best_high"), F.col("is_candidate").alias("best_candidate"))
    base = origin.join(best, "content_id").withColumn(
        "subject", V.resolve_subject(F.lit(None).cast("int"), F.col("claim"), F.col("best_label"), F.col("best_decision")))
    scored = M.claimed_scores(scores, base.select(c.alias("probe_id"), F.col("subject").alias("claim"))).withColumnRenamed(
        "probe_id", "content_id")
    joined = base.join(scored, "content_id", "left")
    decision = V.subject_decision(F.col("own_score"), F.col("impostor"), F.col("subject") < F.col("impostor_id"),
                                  F.lit(0.3591), F.lit(0.47), 0.05)
    third = F.lit(None).cast("boolean")
    user = lambda x: F.when(x.isNotNull(), F.concat(F.lit("user-"), x))
    return joined.select(
        "content_id", user(F.col("subject")).alias("subject_user_id"), (c % 17 != 0).alias("identities_compared"),
        F.when(c % 13 == 0, 0).otherwise(1 + c % 3).cast("int").alias("faces_detected"),
        F.coalesce(decision, F.lit("no_match")).alias("identity_decision"), F.col("own_score").alias("identity_similarity"),
        F.lit(None).cast("double").alias("probe_quality"), F.when(c % 19 != 0, 40 + c % 100).cast("double").alias("probe_face_pixels"),
        F.round(F.col("width") / F.col("asset_width"), 4).alias("copy_scale"), F.col("asset_id").cast("string").alias("asset_id"),
        "asset_owner", F.col("basis").alias("asset_match_basis"), "distribution_id",
        F.when(c % 5 == 0, third).otherwise((c % 5) <= 2).alias("owner_face_in_original"),
        F.coalesce(F.col("asset_id") % 11 == 0, F.lit(False)).alias("asset_shielded"), (c % 2 == 0).alias("registered_faces_compared"),
        F.when(c % 7 == 0, F.lit(True)).when(c % 7 == 1, F.lit(False)).alias("owner_face_kept"),
        F.when(c % 3 == 0, F.lit(True)).when(c % 3 == 1, F.lit(False)).alias("face_in_registered_file"),
        F.when(c % 6 == 4, 60 + c % 50).cast("double").alias("replaced_face_pixels"), (c % 8 == 5).cast("int").alias("degraded_faces"),
        F.when(F.col("best_candidate") & (F.col("best_label") == F.col("subject")), (c % 100) / 100.0).alias("deepfake_score"),
        (c % 2 == 1).alias("deepfake_calibrated"), F.lit("image").alias("media_type"), F.col("best_similarity").alias("face_similarity"),
        F.when(F.col("best_high"), user(F.col("best_label"))).alias("matched_user_id"), "best_decision",
        F.col("code").isNotNull().alias("watermark_detected"), F.col("code").alias("watermark_code"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return V.assess(evidence(spark, sf)).select("content_id", "subject_user_id", "identity_decision", "rule", "verdict", "level")


def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    ruled = V.assess(evidence(spark, sf)).withColumn("identity_decision", F.col("best_decision"))
    return ruled.select("content_id", V.summarize().alias("summary"))


def verdict_explanations(spark: SparkSession, sf: str) -> DataFrame:
    ruled = V.assess(evidence(spark, sf))
    return ruled.select("content_id", F.array_join("explanation", "; ").alias("explanation"), F.array_join("limitations", " ").alias("limitations"))


def verdict_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = V.assess(evidence(spark, sf)).withColumn("situation", F.coalesce("asset_match_basis", F.lit("none")))
    expected = spark.sql("""SELECT * FROM VALUES ('exact', array('own_copy')), ('code', array('own_copy', 'own_unverified')),
        ('perceptual', array('own_unverified')), ('none', array('unrelated', 'review')) AS t(situation, expected)""")
    return V.verdict_scorecard(outcomes, expected)


def _scan_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    items = docs.select(
        F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri"), F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 10 != 9, "image").alias("kind"), (F.col("n_chars") % 23 != 0).alias("ok"), F.col("source").alias("found_on"))
    names = F.array(*[F.lit(v) for v in V.VERDICT_LEVELS])
    ruled = docs.select(F.sha2("text", 256).alias("sha256"), (F.col("n_chars") % 8).cast("int").alias("v"),
                        F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 100) / 100.0).alias("similarity")).distinct()
    ruled = ruled.select("sha256", F.get(names, F.col("v")).alias("verdict"), "similarity")
    return items, ruled.withColumn("level", F.create_map(*[F.lit(x) for p in V.VERDICT_LEVELS.items() for x in p])[F.col("verdict")])


def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    items, ruled = _scan_items(spark, sf)
    return scan.scan_findings(items.where("kind IS NOT NULL"), ruled).select(
        "sha256", "uri", "verdict", "level", "similarity", "places", "found_on")


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_report(*_scan_items(spark, sf))


def _box(vec, k: int):
    x, y = (vec * 7 + k) % 60, (vec * 11 + k) % 50
    return make_box(x, y, x + 20 + vec % 9, y + 24 + vec % 7)


def _copy_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Two faces per copy; the disturbance grows with the id, so all classes of faces occur."""
    vec = F.col("vec_id")
    return planes(spark, sf).select(
        F.floor(vec / 2).alias("content_id"), F.floor(vec / 2).alias("asset_id"), (vec % 2).alias("face_ix"),
        F.transform("plane", lambda x, i: x + (vec % 4) * 0.06 * ((i * (vec + 3)) % 5 - 2)).alias("vector"),
        (60 + vec % 70).cast("double").alias("pixels"), _box(vec, 3).alias("bbox"),
        (F.lit(100) + F.floor(vec / 2) % 4).cast("double").alias("width"), F.lit(80.0).alias("height"),
        F.when(vec % 5 > 0, (vec % 40) / 100.0).alias("own_score"), F.when(vec % 3 > 0, 1.0 + (vec % 16) / 10.0).alias("change_ratio"),
        (F.floor(vec / 2) % 11 == 0).alias("shielded"))


def _registered_faces(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    return planes(spark, sf).select(
        F.floor(vec / 2).alias("asset_id"), (vec % 2).alias("face_ix"), F.col("plane").alias("vector"),
        (70 + vec % 60).cast("double").alias("pixels"), _box(vec, 0).alias("bbox"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"),
        F.when(vec % 7 > 0, (vec % 60) / 100.0).alias("own_score"))


def registered_face_check(spark: SparkSession, sf: str) -> DataFrame:
    out = FC.registered_face_check(_copy_faces(spark, sf), _registered_faces(spark, sf))
    return out.select("content_id", "owner_face_in_original", "owner_face_kept", "faces_kept", "replaced_face_pixels", "face_scale",
                      F.col("faces_degraded").cast("bigint").alias("faces_degraded"))


def copy_face_classes(spark: SparkSession, sf: str) -> DataFrame:
    return FC.compare_faces(_copy_faces(spark, sf), _registered_faces(spark, sf)).select(
        "content_id", "face_ix", r6("similarity"), "decision", "klass", "reg_ix", "aligned")


def nearest_by_centre(spark: SparkSession, sf: str) -> DataFrame:
    return FC.nearest_by_centre(_copy_faces(spark, sf), _registered_faces(spark, sf)).select(
        "content_id", "face_ix", r6("distance"), "near_ix", "near_pixels")


def image_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The whole record per copy: attribution, best face, subject, registered-face check, verdict."""
    vec = F.col("vec_id")
    face = planes(spark, sf).select(
        vec.alias("content_id"), F.lit(0).alias("face_ix"), F.transform("plane", lambda x, i: x + (vec % 4) * 0.06 * ((i * (vec + 3)) % 5 - 2)).alias("vector"),
        F.lit(64).alias("dim"), (60 + vec % 70).cast("double").alias("pixels"), F.lit(None).cast("double").alias("quality"),
        _box(vec, 3).alias("bbox"), F.lit(1.5).alias("change_ratio"))
    reg = planes(spark, sf).select(
        vec.alias("asset_id"), F.lit(0).alias("face_ix"), F.col("plane").alias("vector"), F.lit(64).alias("dim"),
        (70 + vec % 60).cast("double").alias("pixels"), _box(vec, 0).alias("bbox"), (F.lit(200) + (vec % 5) * 40).cast("double").alias("width"),
        (F.lit(150) + (vec % 5) * 30).cast("double").alias("height"), F.concat(F.lit("user-"), F.col("label")).alias("user_id"),
        (vec % 11 == 0).alias("shielded"))
    refs = references(spark, sf).select(F.concat(F.lit("user-"), F.col("user_id")).alias("user_id"), "ref_ix", "vector", "dim")
    content = copies(spark, sf).drop("plane", "label")
    scorer = lambda gated: gated.select("content_id", (F.col("content_id") % 100 / 100.0).alias("deepfake_score"))
    out = images.analyze_images(content, face, assets(spark, sf).drop("plane", "label"), reg, refs, scorer)
    return out.select("content_id", "subject_user_id", "asset_match_basis", "subject_decision", "registered_faces_compared",
                      "face_in_registered_file", "deepfake_score", "rule", "verdict", "level", "summary")


def image_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What the gate before the scorer let through: attribution, subject, its decision, and the score that only a candidate's own face gets."""
    return image_evidence(spark, sf).select("content_id", "subject_user_id", "asset_match_basis", "subject_decision", "deepfake_score")


QUERIES = {f.__name__: f for f in (
    image_gate, verdicts, evidence_summary, verdict_explanations, verdict_scorecard, scan_findings, scan_report, registered_face_check, copy_face_classes,
    nearest_by_centre, image_evidence)}

_EVIDENCE = f"""{_MAX}, {HASHES}, d AS (SELECT a.vec_id AS content_id, b.vec_id AS asset_id, bit_count(xor(a.bits, b.bits)) AS dist
  FROM h a JOIN h b ON a.kind = 'copy' AND b.kind = 'asset'),
  near AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY dist, asset_id) AS rk FROM d),
  att AS (SELECT content_id AS c, CASE WHEN content_id % 4 < 2 THEN content_id WHEN 1.0 - dist / 64 >= 0.8125 THEN asset_id END AS asset,
    CASE content_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'code' ELSE CASE WHEN 1.0 - dist / 64 >= 0.8125 THEN 'perceptual' END END AS basis
    FROM near WHERE rk = 1),
  rk AS (SELECT *, row_number() OVER q AS rn, lead(similarity) OVER q AS nxt FROM p WINDOW q AS (PARTITION BY probe_id
    ORDER BY similarity DESC, user_id)),
  top AS (SELECT probe_id AS c, user_id AS best, similarity AS bs, similarity >= 0.3591 AS cand,
    coalesce(similarity - nxt < 0.05, false) AS dem, CASE WHEN coalesce(similarity - nxt < 0.05, false) AND similarity >= 0.3591
    THEN 'ambiguous' WHEN similarity >= 0.47 AND NOT coalesce(similarity - nxt < 0.05, false) THEN 'high_confidence'
    WHEN similarity >= 0.3591 THEN 'candidate' ELSE 'no_match' END AS bd FROM rk WHERE rn = 1),
  subj AS (SELECT att.*, top.* EXCLUDE c, a.label AS owner, coalesce(a.label, CASE WHEN bd <> 'no_match' THEN best END) AS subject
    FROM att JOIN top USING (c) LEFT JOIN embeddings a ON a.vec_id = att.asset),
  claim AS (SELECT c, max(CASE WHEN user_id = subject THEN similarity END) AS mine,
    max(CASE WHEN user_id <> subject THEN similarity END) AS rival FROM subj JOIN p ON p.probe_id = c WHERE subject IS NOT NULL GROUP BY c),
  ev AS (SELECT s.*, mine, CASE WHEN mine IS NULL OR mine < 0.3591 THEN 'no_match' WHEN mine < rival OR mine - rival < 0.05
    THEN 'ambiguous' WHEN mine >= 0.47 THEN 'high_confidence' ELSE 'candidate' END AS dec,
    CASE WHEN cand AND best = subject THEN (c % 100) / 100 END AS fake, c % 2 = 1 AS cal,
    owner IS NOT NULL AND owner = subject AS owned, coalesce(asset % 11 = 0, false) AS sh, c % 17 <> 0 AS cmp,
    CASE WHEN c % 13 = 0 THEN 0 ELSE 1 + c % 3 END AS faces, CASE WHEN c % 5 = 0 THEN NULL ELSE c % 5 <= 2 END AS orig,
    c % 2 = 0 AS reg, c % 7 = 0 AS kept, CASE c % 3 WHEN 0 THEN true WHEN 1 THEN false END AS infile,
    CASE WHEN c % 6 = 4 THEN 60 + c % 50 END AS repl, c % 8 = 5 AS deg, CASE WHEN c % 19 <> 0 THEN 40 + c % 100 END AS px,
    coalesce(round((160 + (c % 2) * 8) / (200 + (asset % 5) * 40), 4) < 0.9, true) AS shrunk
    FROM subj s LEFT JOIN claim USING (c)),
  ruled AS (SELECT *, CASE WHEN owned THEN
      CASE WHEN basis = 'exact' THEN 'own_exact'
        WHEN dec = 'high_confidence' THEN CASE WHEN cal AND fake >= 0.5 THEN 'own_regenerated' ELSE 'own_face_high' END
        WHEN sh THEN CASE WHEN faces = 0 THEN 'shield_no_face' WHEN NOT reg THEN 'shield_not_compared'
          WHEN repl < 80 AND shrunk THEN 'shield_replaced_small' WHEN repl IS NOT NULL THEN 'shield_replaced'
          WHEN infile THEN 'shield_kept' WHEN deg THEN 'shield_degraded' ELSE 'shield_weak' END
        WHEN NOT cmp THEN 'own_not_enrolled' WHEN orig = false THEN 'own_never_shown' WHEN faces = 0 THEN 'own_no_face'
        WHEN reg THEN CASE WHEN kept THEN 'file_owner_kept' WHEN repl < 80 AND shrunk THEN 'file_replaced_small'
          WHEN repl IS NOT NULL AND orig THEN 'file_replaced' WHEN repl IS NOT NULL THEN 'file_replaced_unsettled'
          WHEN deg THEN 'file_degraded' WHEN infile IS NULL OR dec IN ('candidate', 'ambiguous') THEN 'file_weak'
          WHEN orig THEN 'file_cropped' ELSE 'file_unsettled' END
        WHEN dec IN ('candidate', 'ambiguous') THEN 'own_weak' WHEN px < 80 AND shrunk THEN 'own_small'
        WHEN orig THEN 'own_other_face' ELSE 'own_no_match' END
      WHEN NOT cmp THEN 'nobody_enrolled' WHEN faces = 0 THEN 'no_face'
      WHEN dec = 'high_confidence' THEN CASE WHEN cal AND fake >= 0.5 THEN 'face_synthetic' ELSE 'face_high' END
      WHEN dec = 'ambiguous' THEN 'face_ambiguous' WHEN dec = 'candidate' THEN 'face_candidate'
      WHEN px < 80 THEN 'face_small' ELSE 'face_none' END AS rule FROM ev),
  named(rule, verdict) AS (VALUES ('own_exact', 'own_copy'), ('own_regenerated', 'own_altered'), ('own_face_high', 'own_copy'), ('shield_no_face', 'own_unverified'),
    ('shield_not_compared', 'own_unverified'), ('shield_replaced_small', 'own_unverified'), ('shield_replaced', 'own_altered'), ('shield_kept', 'own_copy'),
    ('shield_degraded', 'own_unverified'), ('shield_weak', 'own_unverified'), ('own_not_enrolled', 'own_unverified'), ('own_never_shown', 'own_copy'),
    ('own_no_face', 'own_unverified'), ('file_owner_kept', 'own_copy'), ('file_replaced_small', 'own_unverified'), ('file_replaced', 'own_altered'),
    ('file_replaced_unsettled', 'own_unverified'), ('file_degraded', 'own_unverified'), ('file_weak', 'own_unverified'), ('file_cropped', 'own_unverified'),
    ('file_unsettled', 'own_unverified'), ('own_weak', 'own_unverified'), ('own_small', 'own_unverified'), ('own_other_face', 'own_altered'),
    ('own_no_match', 'own_unverified'), ('nobody_enrolled', 'inconclusive'), ('no_face', 'unrelated'), ('face_synthetic', 'synthetic_suspected'),
    ('face_high', 'identity_match'), ('face_ambiguous', 'review'), ('face_candidate', 'review'), ('face_small', 'unrelated'),
    ('face_none', 'unrelated')),
  levels(verdict, level) AS (VALUES ('inconclusive', 'low'), ('unrelated', 'low'), ('review', 'low'), ('own_copy', 'low'), ('identity_match', 'medium'), ('own_unverified', 'medium'), ('own_altered', 'high'), ('synthetic_suspected', 'high')),
  final AS (SELECT r.*, n.verdict, CASE WHEN n.verdict = 'synthetic_suspected' AND fake >= 0.8 THEN 'critical' ELSE l.level END AS level
    FROM ruled r JOIN named n USING (rule) JOIN levels l ON l.verdict = n.verdict)"""
# The same over the copies' own disturbed faces, against every reference.
_SHOWN = f"""{UNIT}, shown AS (SELECT vec_id, list(val + (vec_id % 4) * 0.06 * ((i * (vec_id + 3)) % 5 - 2) ORDER BY i) AS w
    FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS val FROM embeddings) GROUP BY 1),
  p AS (SELECT f.vec_id AS probe_id, u.label AS user_id, max(list_dot_product(f.w, u.v) / greatest(sqrt(list_dot_product(f.w, f.w)), 1e-12)) AS similarity
    FROM shown f, u GROUP BY ALL)"""
_SCAN = """names(i, verdict, level) AS (VALUES (0, 'inconclusive', 'low'), (1, 'unrelated', 'low'), (2, 'review', 'low'), (3, 'own_copy', 'low'), (4, 'identity_match', 'medium'), (5, 'own_unverified', 'medium'), (6, 'own_altered', 'high'), (7, 'synthetic_suspected', 'high')),
  items AS (SELECT sha256(text) AS sha256, doc_id, source, n_chars, CASE WHEN doc_id % 10 <> 9 THEN 'image' END AS kind,
    n_chars % 23 <> 0 AS ok FROM documents),
  firsts AS (SELECT sha256, min(doc_id) AS ord, arg_min(source, doc_id) AS found_on, count(*) AS places, any_value(n_chars) AS n
    FROM items WHERE ok AND kind IS NOT NULL GROUP BY 1),
  found AS (SELECT f.*, verdict, level, CASE WHEN n % 3 > 0 THEN (n % 100) / 100 END AS similarity
    FROM firsts f JOIN names ON i = n % 8)"""
_FACES = """cells AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS val FROM embeddings),
  faces AS (SELECT vec_id, list(val + (vec_id % 4) * 0.06 * ((i * (vec_id + 3)) % 5 - 2) ORDER BY i) AS v, list(val ORDER BY i) AS r
    FROM cells GROUP BY 1),
  sims AS (SELECT a.vec_id, a.vec_id // 2 AS content_id, b.vec_id % 2 AS reg_ix,
    list_dot_product(a.v, b.r) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_dot_product(b.r, b.r)), 1e-12)) AS s
    FROM faces a JOIN faces b ON a.vec_id // 2 = b.vec_id // 2),
  lead2 AS (SELECT *, row_number() OVER q AS rn, lead(s) OVER q AS nxt FROM sims WINDOW q AS (PARTITION BY vec_id ORDER BY s DESC, reg_ix)),
  dec AS (SELECT *, coalesce(s - nxt < 0.05, false) AS dem, CASE WHEN coalesce(s - nxt < 0.05, false) AND s >= 0.3591 THEN 'ambiguous'
    WHEN NOT coalesce(s - nxt < 0.05, false) AND s >= 0.47 THEN 'high_confidence' WHEN s >= 0.3591 THEN 'candidate' ELSE 'no_match' END AS decision,
    content_id % 4 <= 2 AS aligned FROM lead2 WHERE rn = 1),
  klass AS (SELECT *, CASE WHEN decision = 'high_confidence' THEN 'kept' WHEN decision <> 'no_match' THEN 'weak'
    WHEN content_id % 11 <> 0 AND vec_id % 5 > 0 AND (vec_id % 40) / 100 >= 0.3591 THEN 'weak'
    WHEN aligned AND vec_id % 3 > 0 AND 1.0 + (vec_id % 16) / 10 < 1.75 THEN 'degraded' ELSE 'replaced' END AS klass FROM dec)"""
_NEAR = """boxes AS (SELECT vec_id, vec_id // 2 AS content_id, (vec_id * 7) % 60 AS x0, (vec_id * 11) % 50 AS y0, (vec_id * 7 + 3) % 60 AS x3,
    (vec_id * 11 + 3) % 50 AS y3, 20 + vec_id % 9 AS bw, 24 + vec_id % 7 AS bh, 100 + (vec_id // 2) % 4 AS cw FROM embeddings),
  dist AS (SELECT a.vec_id, a.content_id, a.vec_id % 2 AS face_ix, b.vec_id % 2 AS near_ix, (70 + b.vec_id % 60)::DOUBLE AS near_pixels,
    sqrt(((2 * a.x3 + a.bw) / 2 / a.cw - (2 * b.x0 + b.bw) / 2 / 100) ** 2 + ((2 * a.y3 + a.bh) / 2 / 80 - (2 * b.y0 + b.bh) / 2 / 80) ** 2) AS distance
    FROM boxes a JOIN boxes b USING (content_id)),
  near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 12), near_ix) AS rn FROM dist)"""

ORACLES = {
    "image_gate": f"""WITH {_EVIDENCE.replace(_MAX, _SHOWN)} SELECT c AS content_id, 'user-' || subject AS subject_user_id, basis AS asset_match_basis,
      dec AS subject_decision, fake AS deepfake_score FROM ev""",
    "verdicts": f"""WITH {_EVIDENCE} SELECT c AS content_id, 'user-' || subject AS subject_user_id, dec AS identity_decision, rule,
      verdict, level FROM final""",
    "evidence_summary": f"""WITH {_EVIDENCE}
      SELECT c AS content_id, concat_ws('; ', 'image ' || verdict || ' ' || coalesce('user-' || subject, 'nobody'),
      format('best={{:.3f}}', bs) || CASE WHEN NOT dem AND bs >= 0.47 THEN ' user-' || best ELSE '' END, 'decision=' || bd,
      CASE WHEN fake IS NOT NULL THEN format('synthetic={{:.3f}}', fake) END,
      CASE WHEN c % 4 = 1 THEN format('mark={{:08x}}', c * 7919 + 65536) ELSE 'mark=none' END) AS summary FROM final""",
    "verdict_explanations": f"""WITH {_EVIDENCE}, x AS (SELECT *, round((160 + (c % 2) * 8) / (200 + (asset % 5) * 40), 4) AS scale FROM final)
      SELECT c AS content_id, concat_ws('; ', 'rule=' || rule, 'asset=' || asset, 'owner=user-' || owner, 'basis=' || basis, 'channel=channel-' || asset % 3,
      format('similarity={{:.3f}}', mine), 'decision=' || dec, format('face_pixels={{:.0f}}', px::DOUBLE), format('replaced_pixels={{:.0f}}', repl::DOUBLE),
      format('copy_scale={{:.2f}}', scale), format('synthetic={{:.3f}} ', fake) || CASE WHEN cal THEN 'calibrated' ELSE 'uncalibrated' END) AS explanation,
      concat_ws(' ', 'similarity-is-evidence unknown-is-not-no', CASE WHEN rule IN ('own_small', 'face_small', 'file_replaced_small', 'shield_replaced_small')
      THEN 'small-face' END, CASE WHEN rule IN ('own_weak', 'own_small', 'own_no_match', 'own_no_face') AND orig IS NULL THEN 'registered-file-unchecked' END,
      CASE WHEN rule = 'own_not_enrolled' THEN 'owner-not-enrolled' END, CASE WHEN rule = 'shield_not_compared' THEN 'shielded-file-missing' END,
      CASE WHEN fake IS NOT NULL AND NOT cal THEN 'score-uncalibrated' END) AS limitations FROM x""",
    "verdict_scorecard": f"""WITH {_EVIDENCE}, s AS (SELECT coalesce(basis, 'none') AS situation, verdict, level FROM final)
      SELECT situation, count(*) AS cases, count(*) FILTER (WHERE (situation, verdict) IN (('exact', 'own_copy'), ('code', 'own_copy'),
      ('code', 'own_unverified'), ('perceptual', 'own_unverified'), ('none', 'unrelated'), ('none', 'review'))) AS as_expected,
      {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in V.VERDICT_LEVELS)},
      {", ".join(f"count(*) FILTER (WHERE level = '{v}') AS level_{v}" for v in ("low", "medium", "high", "critical"))}
      FROM s GROUP BY situation""",
    "scan_findings": f"""WITH {_SCAN} SELECT sha256, 'doc/' || ord AS uri, verdict, level, similarity, places, found_on FROM found
      WHERE verdict NOT IN ('unrelated', 'inconclusive')""",
    "scan_report": f"""WITH {_SCAN} SELECT (SELECT count(*) FROM items) AS discovered, (SELECT count(*) FROM items WHERE kind IS NULL) AS not_media,
      count(*) AS analysed, (SELECT count(*) FROM items WHERE kind IS NOT NULL AND ok) - count(*) AS duplicates,
      (SELECT count(*) FROM items WHERE kind IS NOT NULL AND NOT ok) AS failures,
      count(*) FILTER (WHERE verdict NOT IN ('unrelated', 'inconclusive')) AS flagged FROM found""",
    "copy_face_classes": f"""WITH {_FACES} SELECT content_id, vec_id % 2 AS face_ix, round(s, 6) AS similarity, decision, klass, reg_ix,
      aligned FROM klass""",
    "nearest_by_centre": f"""WITH {_NEAR} SELECT content_id, face_ix, round(distance, 6) AS distance, near_ix, near_pixels FROM near WHERE rn = 1""",
    "registered_face_check": f"""WITH {_FACES}, {_NEAR},
      own AS (SELECT vec_id // 2 AS content_id, vec_id % 2 AS ix, (vec_id % 60) / 100 AS o, row_number() OVER (PARTITION BY vec_id // 2
        ORDER BY CASE WHEN (vec_id % 60) / 100 >= 0.47 THEN 3 WHEN (vec_id % 60) / 100 >= 0.3591 THEN 2 ELSE 0 END DESC,
        (vec_id % 60) / 100 DESC, vec_id) AS rn FROM embeddings WHERE vec_id % 7 > 0),
      o AS (SELECT DISTINCT e.vec_id // 2 AS content_id, CASE WHEN o IS NULL OR o < 0.3591 THEN false WHEN o >= 0.47 THEN true END AS shown,
        CASE WHEN o >= 0.47 THEN ix END AS owner_ix FROM embeddings e LEFT JOIN own ON own.content_id = e.vec_id // 2 AND rn = 1),
      k AS (SELECT k.*, (60 + k.vec_id % 70)::DOUBLE AS pixels, near_pixels, 70 + (k.content_id * 2 + k.reg_ix) % 60 AS reg_pixels,
        shown, owner_ix FROM klass k JOIN near n ON n.vec_id = k.vec_id AND n.rn = 1 JOIN o ON o.content_id = k.content_id),
      g AS (SELECT content_id, any_value(aligned) AS aligned, any_value(shown) AS shown, any_value(owner_ix) AS owner_ix,
        coalesce(bool_or(klass = 'kept' AND reg_ix = owner_ix), false) AS kept_owner, count(*) FILTER (WHERE klass = 'replaced') AS rep,
        count(*) FILTER (WHERE klass = 'weak') AS weak, count(*) FILTER (WHERE klass = 'degraded') AS deg,
        max(CASE WHEN klass = 'replaced' THEN pixels END) AS big,
        arg_max(near_pixels, CASE WHEN klass = 'replaced' THEN pixels * 10 - vec_id % 2 END) AS near_big,
        quantile_cont(CASE WHEN klass = 'kept' THEN pixels / reg_pixels END, 0.5) AS ratio FROM k GROUP BY content_id)
      SELECT content_id, CASE WHEN content_id % 11 <> 0 THEN shown END AS owner_face_in_original,
      CASE WHEN content_id % 11 <> 0 AND owner_ix IS NOT NULL THEN kept_owner END AS owner_face_kept,
      CASE WHEN rep > 0 THEN false WHEN weak = 0 AND deg = 0 THEN true END AS faces_kept,
      CASE WHEN rep > 0 THEN big END AS replaced_face_pixels,
      round(coalesce(ratio, CASE WHEN aligned THEN 1.0 END, CASE WHEN rep > 0 THEN big / near_big END), 4) AS face_scale,
      deg AS faces_degraded FROM g""",
}
