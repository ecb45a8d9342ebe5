"""Queries on operating characteristics: document length as score, photo pairs as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import LABELLED, UNIT, labelled_documents, photos
from sightline.operators import calibration as C
from sightline.operators import matching as M
from sightline.operators.evaluation import margin_stats as margin_report

r6 = lambda name: F.round(name, 6).alias(name)


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    points = C.roc_points(labelled_documents(spark, sf), ["grp"], "ord")
    finite = F.when(F.col("threshold") < F.lit(float("inf")), F.col("threshold")).alias("threshold")
    return C.with_origin(points, ["grp"]).select("grp", "point", finite, r6("tpr"), r6("fpr"))


def auc_eer(spark: SparkSession, sf: str) -> DataFrame:
    points = C.roc_points(labelled_documents(spark, sf), ["grp"], "ord")
    return C.auc_eer(points, ["grp"]).select("grp", "genuine", "impostor", r6("auc"), r6("eer"), "eer_threshold")


def _pair_table(spark: SparkSession, sf: str) -> DataFrame:
    return M.pair_score_counts(photos(spark, sf), 4).withColumn("grp", F.lit("pairs"))


def pair_auc_eer(spark: SparkSession, sf: str) -> DataFrame:
    points = C.roc_points(_pair_table(spark, sf), ["grp"])
    return C.auc_eer(points, ["grp"]).select("genuine", "impostor", r6("auc"), r6("eer"), "eer_threshold")


def calibrated_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    points = C.roc_points(labelled_documents(spark, sf), ["grp"], "ord")
    return C.calibrate(points, ["grp"], 0.05).select(
        "grp", "criterion", "threshold", "genuine", "impostor", r6("tpr"), r6("fpr"), r6("precision"),
        F.size("notes").alias("notes"))


def confusion_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = C.confusion_at(labelled_documents(spark, sf), ["grp"], F.lit(1000.0))
    return out.select("grp", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"), r6("fpr"))


def threshold_for_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = C.threshold_for_precision(labelled_documents(spark, sf), ["grp"], 0.1)
    return out.select("grp", "threshold", "tp", "fp", r6("precision"), "reached")


def rank_auc(spark: SparkSession, sf: str) -> DataFrame:
    return C.rank_auc(labelled_documents(spark, sf), ["grp"]).select("grp", "genuine", "impostor", r6("auc"))


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.summary(labelled_documents(spark, sf), "score", ["grp"]).select(
        "grp", "n", r6("mean"), "minimum", "maximum")


def threshold_placement_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds placed on the identity scores, and the bands they cut there."""
    scores = M.identity_score_counts(photos(spark, sf), 4).withColumn("grp", F.lit("all"))
    placed = C.place_thresholds(scores, ["grp"])
    cut = scores.join(placed, "grp")
    counted = C.bands(cut, ["grp", "review_at", "high_at", "separated"], F.col("review_at"), F.col("high_at"))
    return counted.select("label", r6("review_at"), r6("high_at"), "separated", "high", "review", "below")


def margin_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Lead of the best over the second identity per probe, leave-one-out."""
    side = photos(spark, sf)
    probes = side.select(F.col("name").alias("probe_id"), "vector", F.size("vector").alias("dim"))
    refs = side.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"),
                       F.col("name").alias("ref_name"), "vector", F.size("vector").alias("dim"))
    ranked = M.rank_identities(M.identity_scores(probes, refs, exclude_self=True))
    return margin_report(ranked).select("probes", r6("minimum"), r6("p1"), r6("median"))


def score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of the pair distribution per class, without expanding it."""
    return C.weighted_quantiles(M.pair_score_counts(photos(spark, sf), 4), ["label"],
                                {"p5": 0.05, "p50": 0.5, "p99": 0.99, "p999": 0.999}).select(
        "label", "n", r6("p5"), r6("p50"), r6("p99"), r6("p999"))


QUERIES = {f.__name__: f for f in (
    roc_curve, auc_eer, pair_auc_eer, calibrated_thresholds, confusion_at_threshold, threshold_for_precision,
    rank_auc, score_summary, threshold_placement_bands, margin_stats, score_quantiles)}
QUERIES["roc_points"] = QUERIES.pop("roc_curve")

_CURVE = """t AS (SELECT grp, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY grp),
  c AS (SELECT s.grp, s.score, s.label, s.ord, t.p, t.n, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp,
  row_number() OVER w AS point FROM s JOIN t USING (grp) WHERE t.p > 0 AND t.n > 0
  WINDOW w AS (PARTITION BY grp ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING))"""
_AREA = "sum(CASE WHEN label = 0 THEN 2 * tp ELSE 0 END) / (2.0 * any_value(p) * any_value(n))"
_PAIRS = f"""{UNIT}, s AS (SELECT (a.label = b.label)::INT AS label,
  round(list_dot_product(a.v, b.v) * 1e4)::BIGINT / 10000 AS score FROM u a JOIN u b ON a.vec_id < b.vec_id)"""
_DISTINCT = """t AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM s),
  d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d, t WINDOW w AS (ORDER BY score DESC))"""

ORACLES = {
    "roc_points": f"""WITH {LABELLED}, {_CURVE} SELECT grp, point, score AS threshold, round(tp / p, 6) AS tpr,
      round(fp / n, 6) AS fpr FROM c UNION ALL
      SELECT DISTINCT grp, 0, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c""",
    "auc_eer": f"""WITH {LABELLED}, {_CURVE}, a AS (SELECT grp, any_value(p)::BIGINT AS genuine,
      any_value(n)::BIGINT AS impostor, round({_AREA}, 6) AS auc FROM c GROUP BY grp),
      e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(p * n - tp * n - fp * p), point) AS rk FROM c)
      SELECT a.grp, genuine, impostor, auc, round((1.0 - tp / p + fp / n) / 2.0, 6) AS eer, score AS eer_threshold
      FROM a JOIN e ON a.grp = e.grp AND rk = 1""",
    "pair_auc_eer": f"""WITH {_PAIRS}, {_DISTINCT}, e AS (SELECT *, row_number() OVER
      (ORDER BY abs(p * n - tp * n - fp * p), score DESC) AS rk FROM c), a AS (SELECT
      any_value(p)::BIGINT AS genuine, any_value(n)::BIGINT AS impostor,
      sum(neg * (2 * tp - pos)) / (2.0 * any_value(p) * any_value(n)) AS auc FROM c)
      SELECT genuine, impostor, round(auc, 6) AS auc, round((1.0 - tp / p + fp / n) / 2.0, 6) AS eer,
      score AS eer_threshold FROM a, e WHERE rk = 1""",
    "calibrated_thresholds": f"""WITH {LABELLED}, {_CURVE},
      k AS (SELECT grp, any_value(p) AS p, any_value(n) AS n, max(score) AS top,
      arg_min(score, abs(p * n - tp * n - fp * p) * 1000000 + point) AS eer,
      CASE WHEN max(tp * n - fp * p) > 0 THEN arg_min(score, -(tp * n - fp * p) * 1000000 + point) ELSE max(score)
      END AS youden,
      coalesce(arg_max(score, CASE WHEN fp <= 0.05 * n THEN point END), max(score)) AS max_fpr,
      min(CASE WHEN label = 1 THEN score END) AS lo, max(CASE WHEN label = 0 THEN score END) AS hi FROM c GROUP BY grp),
      r AS (SELECT grp, p, n, 'eer' AS criterion, eer AS threshold, 0 AS extra FROM k
      UNION ALL SELECT grp, p, n, 'youden', youden, 0 FROM k UNION ALL SELECT grp, p, n, 'max_fpr', max_fpr, 0 FROM k
      UNION ALL SELECT grp, p, n, 'max_margin', CASE WHEN lo > hi THEN (lo + hi) / 2 ELSE eer END, 1 FROM k)
      SELECT r.grp, criterion, threshold, any_value(r.p)::BIGINT AS genuine, any_value(r.n)::BIGINT AS impostor,
      round(sum(label) / greatest(any_value(r.p), 1), 6) AS tpr,
      round(sum(1 - label) / greatest(any_value(r.n), 1), 6) AS fpr,
      round(sum(label) / greatest(count(*), 1), 6) AS precision,
      any_value(extra) + (any_value(r.p) < 10 OR any_value(r.n) < 10)::INT AS notes
      FROM r JOIN c ON r.grp = c.grp AND c.score >= r.threshold GROUP BY r.grp, criterion, threshold""",
    "confusion_at_threshold": f"""WITH {LABELLED}, k AS (SELECT grp,
      count(*) FILTER (WHERE score >= 1000 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 1000 AND label = 0) AS fp,
      count(*) FILTER (WHERE score < 1000 AND label = 1) AS fn, count(*) FILTER (WHERE score < 1000 AND label = 0) AS tn
      FROM s GROUP BY grp), r AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM k)
      SELECT grp, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall,
      round(2 * pr * rc / greatest(pr + rc, 1e-12), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS fpr FROM r""",
    "threshold_for_precision": f"""WITH {LABELLED}, d AS (SELECT grp, score, sum(label) AS pos, count(*) AS m FROM s
      GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(m) OVER w AS total FROM d
      WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
      k AS (SELECT grp, coalesce(min(CASE WHEN tp > 0 AND tp >= 0.1 * total THEN score END), max(score)) AS threshold,
      count(CASE WHEN tp > 0 AND tp >= 0.1 * total THEN 1 END) > 0 AS reached FROM c GROUP BY grp)
      SELECT k.grp, threshold, tp::BIGINT AS tp, (total - tp)::BIGINT AS fp, round(tp / total, 6) AS precision, reached
      FROM k JOIN c ON k.grp = c.grp AND c.score = threshold""",
    "rank_auc": f"""WITH {LABELLED} SELECT a.grp, count(DISTINCT a.ord) AS genuine, count(DISTINCT b.ord) AS impostor,
      round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc
      FROM s a JOIN s b ON a.grp = b.grp AND a.label = 1 AND b.label = 0 GROUP BY a.grp""",
    "score_summary": f"""WITH {LABELLED} SELECT grp, count(*) AS n, round(avg(score), 6) AS mean,
      min(score) AS minimum, max(score) AS maximum FROM s GROUP BY grp""",
    "threshold_placement_bands": f"""WITH {UNIT}, p AS (SELECT a.vec_id, a.label AS own, b.label AS user_id,
      round(max(list_dot_product(a.v, b.v)) * 1e4)::BIGINT / 10000 AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id
      GROUP BY ALL), s AS (SELECT (own = user_id)::INT AS label, score FROM p),
      g AS (SELECT min(CASE WHEN label = 1 THEN score END) AS lo, max(CASE WHEN label = 0 THEN score END) AS hi FROM s),
      t AS (SELECT (lo + hi) / 2 - abs(lo - hi) / 4 AS review_at, (lo + hi) / 2 + abs(lo - hi) / 4 AS high_at,
      lo - hi > 0 AS separated FROM g)
      SELECT label, round(review_at, 6) AS review_at, round(high_at, 6) AS high_at, separated,
      count(*) FILTER (WHERE score >= high_at) AS high,
      count(*) FILTER (WHERE score >= review_at AND score < high_at) AS review,
      count(*) FILTER (WHERE score < review_at) AS below FROM s, t GROUP BY ALL""",
    "margin_stats": f"""WITH {UNIT}, p AS (SELECT a.vec_id, b.label, max(list_dot_product(a.v, b.v)) AS c
      FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL), w AS (SELECT vec_id, c,
      row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS rn,
      lead(c) OVER (PARTITION BY vec_id ORDER BY c DESC) AS nxt FROM p)
      SELECT count(c - nxt) AS probes, round(min(round(c - nxt, 6)), 6) AS minimum,
      round(quantile_cont(round(c - nxt, 6), 0.01), 6) AS p1, round(quantile_cont(round(c - nxt, 6), 0.5), 6) AS median FROM w WHERE rn = 1""",
    "score_quantiles": f"""WITH {_PAIRS} SELECT label, count(*) AS n, round(quantile_cont(score, 0.05), 6) AS p5,
      round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.99), 6) AS p99,
      round(quantile_cont(score, 0.999), 6) AS p999 FROM s GROUP BY label""",
}
