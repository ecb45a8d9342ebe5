"""Operating characteristics of labelled scores, per group.

Two inputs are understood. A *row table* ``(keys, score, label, ord)`` keeps every score as one
point, in stable descending order, ties by ``ord`` and not collapsed. A *distribution*
``(keys, score, label, n)`` without ``ord`` has one point per distinct score, so ties count half.
All comparisons between points are made on integer counts, which makes them exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.prefix import running_sums
from sightline.session import checked_broadcast, cut_lineage


def roc_points(scores: DataFrame, keys: Sequence[str], ord: str | None = None) -> DataFrame:
    """Cumulative counts by descending score: ``(keys, score, pos, neg, tp, fp, p, n)``.

    Groups with one class only have no curve and return nothing. The point before the first score
    (threshold infinity, no positives) is added by :func:`with_origin`.
    """
    weight = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    label = F.col("label").cast("bigint")
    base = scores.select(*keys, F.col("score").cast("double").alias("score"), *([ord] if ord else []),
                         (label * weight).alias("pos"), ((1 - label) * weight).alias("neg"))
    if ord is None:
        base = base.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    order = [F.col("score").desc(), *([F.col(ord).asc()] if ord else [])]
    points = running_sums(base, keys, order, {"tp": "pos", "fp": "neg"}, {"p": "tp", "n": "fp"})
    return points.where((F.col("p") > 0) & (F.col("n") > 0))


def with_origin(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC rates with the leading (infinity, 0, 0) point."""
    rates = points.select(*keys, (F.col("tp") + F.col("fp")).alias("point"), F.col("score").alias("threshold"),
                          (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))
    zero = F.lit(0.0)
    origin = points.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("point"), F.lit(float("inf")).alias("threshold"),
        zero.alias("tpr"), zero.alias("fpr"))
    return rates.unionByName(origin)


def _position() -> Column:
    return F.col("tp") + F.col("fp")


def auc_eer(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the curve, equal error rate and its threshold per group."""
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos"))
    gap = F.abs(F.col("p") * F.col("n") - F.col("tp") * F.col("n") - F.col("fp") * F.col("p"))
    entry = F.struct(gap.alias("gap"), _position().alias("at"), "score", "tp", "fp")
    out = points.groupBy(*keys).agg(
        F.sum(area.cast("decimal(38,0)")).cast("double").alias("area"), F.first("p").alias("genuine"),
        F.first("n").alias("impostor"), F.min(entry).alias("e"))
    tpr, fpr = F.col("e.tp") / F.col("genuine"), F.col("e.fp") / F.col("impostor")
    return out.select(*keys, "genuine", "impostor",
                      (F.col("area") / (2.0 * F.col("genuine") * F.col("impostor"))).alias("auc"),
                      ((1.0 - tpr + fpr) / 2.0).alias("eer"), F.col("e.score").alias("eer_threshold"))


def rank_auc(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability that a positive outranks a negative, ties half (Mann-Whitney)."""
    points = roc_points(scores, keys)
    return auc_eer(points, keys).select(*keys, "genuine", "impostor", "auc")


def calibrate(points: DataFrame, keys: Sequence[str], target_fpr: float = 0.01,
              independent_pairs: int | None = None) -> DataFrame:
    """Thresholds of the four criteria with their operating points: one row per group and criterion.

    ``eer`` balances the errors, ``youden`` takes the first maximum of TPR - FPR, ``max_fpr`` the last
    point within ``target_fpr`` and ``max_margin`` the middle between separable classes (else EER).
    """
    gap = F.abs(F.col("p") * F.col("n") - F.col("tp") * F.col("n") - F.col("fp") * F.col("p"))
    lift = F.col("tp") * F.col("n") - F.col("fp") * F.col("p")
    at = _position()
    admissible = F.col("fp") <= F.lit(float(target_fpr)) * F.col("n")
    chosen = points.groupBy(*keys).agg(
        F.first("p").alias("genuine"), F.first("n").alias("impostor"), F.max("score").alias("top"),
        F.min(F.struct(gap.alias("gap"), at.alias("at"), "score")).alias("eer"),
        F.min(F.struct((-lift).alias("loss"), at.alias("at"), "score")).alias("youden"),
        F.max(F.when(admissible, F.struct(at.alias("at"), "score"))).alias("max_fpr"),
        F.min(F.when(F.col("pos") > 0, F.col("score"))).alias("low_genuine"),
        F.max(F.when(F.col("neg") > 0, F.col("score"))).alias("high_impostor"))
    separable = F.col("low_genuine") > F.col("high_impostor")
    thresholds = {
        "eer": F.col("eer.score"),
        "youden": F.when(F.col("youden.loss") < 0, F.col("youden.score")).otherwise(F.col("top")),
        "max_fpr": F.coalesce(F.col("max_fpr.score"), F.col("top")),
        "max_margin": F.when(separable, (F.col("low_genuine") + F.col("high_impostor")) / 2)
        .otherwise(F.col("eer.score")),
    }
    few = (F.col("genuine") < 10) | (F.col("impostor") < 10)
    narrow = F.lit(independent_pairs is not None and independent_pairs < 30)
    rows = chosen.select(*keys, "genuine", "impostor", F.explode(F.array(*[
        F.struct(F.lit(name).alias("criterion"), value.alias("threshold"),
                 F.array_compact(F.array(
                     F.when(F.lit(name == "max_margin") & separable, F.lit("separable classes")),
                     F.when(F.lit(name == "max_margin") & ~separable, F.lit("classes overlap: equal error rate used")),
                     F.when(few, F.lit("provisional: fewer than 10 pairs of a class")),
                     F.when(narrow, F.lit("fewer than 30 independent pairs")))).alias("notes"))
        for name, value in thresholds.items()])).alias("c")).select(*keys, "genuine", "impostor", "c.*")
    rows = cut_lineage(rows)
    reached = (points.join(checked_broadcast(rows.select(*keys, "criterion", "threshold")), list(keys))
               .where(F.col("score") >= F.col("threshold"))
               .groupBy(*keys, "criterion").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp")))
    out = rows.join(reached, [*keys, "criterion"], "left")
    tp, fp = F.coalesce(F.col("tp"), F.lit(0)), F.coalesce(F.col("fp"), F.lit(0))
    one = F.lit(1).cast("bigint")
    return out.select(
        *keys, "criterion", "threshold", "genuine", "impostor",
        (tp / F.greatest(F.col("genuine"), one)).alias("tpr"),
        (fp / F.greatest(F.col("impostor"), one)).alias("fpr"),
        (tp / F.greatest(tp + fp, one)).alias("precision"), "notes")


def confusion_at(scores: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Confusion counts and rates at ``score >= threshold``."""
    weight = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    hit, genuine = F.col("score") >= threshold, F.col("label") == 1
    count = lambda c: F.sum(F.when(c, weight).otherwise(F.lit(0))).cast("bigint")
    out = scores.groupBy(*keys).agg(
        count(hit & genuine).alias("tp"), count(hit & ~genuine).alias("fp"),
        count(~hit & genuine).alias("fn"), count(~hit & ~genuine).alias("tn"))
    one = F.lit(1).cast("bigint")
    rate = lambda a, b: a / F.greatest(b, one)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
                     rate(fp, fp + tn).alias("fpr"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-12)))


def threshold_for_precision(scores: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """Lowest score reaching the precision with at least one hit; else the highest score."""
    weight = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    label = F.col("label").cast("bigint")
    base = (scores.groupBy(*keys, F.col("score").cast("double").alias("score"))
            .agg(F.sum(label * weight).alias("pos"), F.sum((1 - label) * weight).alias("neg")))
    points = running_sums(base, keys, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})
    good = (F.col("tp") > 0) & (F.col("tp") >= F.lit(float(target)) * (F.col("tp") + F.col("fp")))
    entry = F.struct("score", "tp", "fp")
    out = points.groupBy(*keys).agg(F.min(F.when(good, entry)).alias("reached"), F.max(entry).alias("top"))
    best = F.coalesce("reached", "top")
    return out.select(*keys, best["score"].alias("threshold"), best["tp"].alias("tp"), best["fp"].alias("fp"),
                      (best["tp"] / (best["tp"] + best["fp"])).alias("precision"),
                      F.col("reached").isNotNull().alias("reached"))


def summary(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, minimum and maximum of the known values; nothing for an empty column."""
    c = F.col(column)
    out = df.where(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("minimum"), F.max(c).alias("maximum"))
    return out.where("n > 0")


def place_thresholds(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Review and high thresholds a quarter of the class gap around its middle."""
    low = F.min(F.when(F.col("label") == 1, F.col("score")))
    high = F.max(F.when(F.col("label") == 0, F.col("score")))
    out = scores.groupBy(*keys).agg(low.alias("low_genuine"), high.alias("high_impostor"))
    middle = (F.col("low_genuine") + F.col("high_impostor")) / 2
    gap = F.col("low_genuine") - F.col("high_impostor")
    return out.select("*", (gap > 0).alias("separated"),
                      (middle - F.abs(gap) / 4).alias("review_at"), (middle + F.abs(gap) / 4).alias("high_at"))


def bands(scores: DataFrame, keys: Sequence[str], review_at: Column, high_at: Column) -> DataFrame:
    """How many scores of each class land in the high, review and below bands."""
    weight = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    count = lambda c: F.sum(F.when(c, weight).otherwise(F.lit(0))).cast("bigint")
    s = F.col("score")
    return scores.groupBy(*keys, "label").agg(
        count(s >= high_at).alias("high"), count((s >= review_at) & (s < high_at)).alias("review"),
        count(s < review_at).alias("below"))


def weighted_quantiles(counts: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of a distribution ``(keys, score, n)``.

    The rank of a quantile falls between two order statistics; both are read off the running counts,
    so nothing is expanded to one row per observation.
    """
    base = counts.groupBy(*keys, "score").agg(F.sum("n").alias("n"))
    up = running_sums(base, keys, [F.col("score").asc()], {"upto": "n"}, {"total": "upto"})
    aggs = []
    for name, q in quantiles.items():
        rank = F.lit(float(q)) * (F.col("total") - 1)
        at = lambda position: F.min(F.when(F.col("upto") > position, F.col("score")))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        share = F.first(rank - F.floor(rank))
        aggs.append((low + (high - low) * share).alias(name))
    return up.groupBy(*keys).agg(F.first("total").alias("n"), *aggs)
