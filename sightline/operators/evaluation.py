"""Evaluation reports: splits, detector gates, conditions, tails, cohorts, marks, fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.intervals import clopper_pearson_upper
from sightline.operators import calibration as C
from sightline.operators.blocks import block_join, group_bounds, stripes, unit_matrix
from sightline.operators.matching import identity_count
from sightline.operators.prefix import ordered_rank, running_balance, running_sums
from sightline.session import checked_broadcast, cut_lineage
from sightline.settings import FaceThresholds, GateRules

# Face-width bands and minimum-width rules, in pixels.
WIDTH_EDGES = [0, 48, 64, 80, 96]
SIZE_RULES = [64, 80, 96]


def seeded(seed: int, key: Column) -> Column:
    """Reproducible shuffle key of a name."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_people(people: DataFrame, share: float, seed: int) -> DataFrame:
    """The first ``share`` of the shuffled people calibrate: ``(person, calibrates)``."""
    named = people.select("person").distinct().withColumn("mix", seeded(seed, F.col("person")))
    ranked = ordered_rank(named, [], [F.col("mix"), F.col("person")], "rank")
    total = named.agg(F.rint(F.count("*") * F.lit(share)).cast("bigint").alias("cut")).withColumn("one", F.lit(1))
    return ranked.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("person", (F.col("rank") <= F.col("cut")).alias("calibrates"))


def split_half(items: DataFrame, share: float = 0.5, seed: int = 0, key: str = "item") -> DataFrame:
    """Add ``half``: calibration, test, or split for an item with people on both sides."""
    shown = items.select(key, F.explode("people").alias("person"))
    sides = split_people(shown, share, seed)
    judged = shown.join(sides, "person").groupBy(key).agg(F.bool_and("calibrates").alias("all"), F.bool_or("calibrates").alias("any"))
    half = F.when(F.col("all"), "calibration").when(~F.col("any"), "test").otherwise("split")
    return items.join(judged.select(key, half.alias("half")), key, "left").withColumn("half", F.coalesce("half", F.lit("test")))


def known(score: Column) -> Column:
    """Scored at all; NaN and NULL mean that no face was found."""
    return score.isNotNull() & ~F.isnan(score)


def detector_threshold(items: DataFrame, scores: DataFrame, quantile: float) -> DataFrame:
    """Exact quantile of the clean scores of calibration genuine items: ``(detector, threshold, fitting)``."""
    clean = scores.where((F.col("degradation") == "clean") & known(F.col("score")))
    fit = clean.join(items.where("half = 'calibration' AND label <> 'fake'").select("item"), "item").groupBy("detector", "score").agg(
        F.count("*").alias("n"))
    return C.weighted_quantiles(fit, ["detector"], {"threshold": quantile}).withColumnRenamed("n", "fitting")


def judged_scores(items: DataFrame, scores: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """``scores`` with their items and each detector's threshold, kept for the reports that follow.

    ``items(item, ord, label, family, half, shared)``, ``scores(detector, item, degradation, score)``. ``shared`` marks
    the genuine items every family is separated from.
    """
    limit = cut_lineage(detector_threshold(items, scores, rules.quantile))  # one row per detector
    return cut_lineage(scores.join(items, "item").join(checked_broadcast(limit), "detector"))


def genuine_report(judged: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """False positives on genuine test items per detector and degradation, with their exact upper bound."""
    seen = known(F.col("score"))
    report = judged.where((F.col("label") != "fake") & (F.col("half") == "test")).groupBy("detector", "degradation").agg(
        F.first("threshold").alias("threshold"), F.count_if(seen).alias("test_photos"),
        F.count_if(seen & (F.col("score") >= F.col("threshold"))).alias("false_positives"), F.count_if(~seen).alias("undetected"))
    photos, alarms = F.col("test_photos"), F.col("false_positives")
    return report.withColumns({
        "rate": alarms / F.greatest(photos, F.lit(1)),
        "upper_95": F.when(photos > 0, clopper_pearson_upper(F.when(photos > 0, alarms), F.when(photos > 0, photos), rules.confidence))})


def family_report(judged: DataFrame) -> DataFrame:
    """Separation and recall of every family of fakes per detector and degradation.

    Shared genuine items stand against every family. They are counted along one order of all scores, and each fake reads how
    many come after it, so no genuine row is copied per family.
    """
    keys = ["detector", "degradation", "family"]
    seen, fake = known(F.col("score")), F.col("label") == "fake"
    line = judged.where(seen & (fake | F.col("shared"))).select(
        "detector", "degradation", "family", "score", "ord", fake.alias("fake"), (~fake).cast("bigint").alias("genuine"))
    placed = running_sums(line, ["detector", "degradation"], [F.col("score").desc(), F.col("ord").asc()], {"before": "genuine"}, {"all": "before"})
    separation = placed.where("fake").groupBy(*keys).agg(
        (F.sum(F.col("all") - F.col("before")) / F.sum(F.nullif("all", F.lit(0)))).alias("separation_auc"))
    recall = judged.where(fake & seen & (F.col("half") == "test")).groupBy(*keys).agg(
        F.count("*").alias("test_fakes"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("recall"))
    families = judged.where(fake).select("family").distinct().withColumn("one", F.lit(1))
    grid = judged.select("detector", "degradation").distinct().withColumn("one", F.lit(1)).join(families, "one").drop("one")  # all three are names
    return grid.join(separation, keys, "left").join(recall, keys, "left").withColumn("test_fakes", F.coalesce("test_fakes", F.lit(0)))


def evaluate_detector(items: DataFrame, scores: DataFrame, rules: GateRules = GateRules()) -> tuple[DataFrame, DataFrame]:
    """Genuine report per degradation and family report per (family, degradation), for every detector."""
    judged = judged_scores(items, scores, rules)
    return genuine_report(judged, rules), family_report(judged)


def detector_gate(report: DataFrame, families: DataFrame, leaked: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """Detectors with every reason they fail; none means the detector passes."""
    bound = F.col("upper_95")
    alarms = report.where(bound.isNull() | (bound > rules.max_false_positive)).select(
        "detector", F.concat("degradation", F.lit(": false-positive bound too high")).alias("reason"))
    recall = families.where((F.col("degradation") == "clean") & (F.col("recall").isNull() | (F.col("recall") < rules.min_recall))).select(
        "detector", F.concat("family", F.lit(": recall too low")).alias("reason"))
    sample = leaked.select("detector", F.lit("trained on an evaluated manifest").alias("reason")).distinct()
    reasons = alarms.unionByName(recall).unionByName(sample).groupBy("detector").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return report.select("detector").distinct().join(reasons, "detector", "left").select(
        "detector", F.col("reasons").isNull().alias("passes"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def condition_bands(items: DataFrame, threshold: Column) -> DataFrame:
    """Alarms and recall per condition, face-width band and minimum-width rule, over test items.

    ``items(condition, label, family, width, score, half)``. Rows: kind condition / band / rule, its name,
    family (NULL for genuine), n, hits, and for rules the share the rule abstains on.
    """
    test = items.where((F.col("half") == "test") & known(F.col("score"))).withColumn("hit", (F.col("score") >= threshold).cast("int"))
    family = F.when(F.col("label") == "fake", F.col("family")).alias("family")
    band = F.lit(f"{WIDTH_EDGES[-1]}-")
    for low, high in reversed(list(zip(WIDTH_EDGES[:-1], WIDTH_EDGES[1:]))):
        band = F.when(F.col("width") < high, F.lit(f"{low}-{high}")).otherwise(band)
    rules = F.array_compact(F.array(*[F.when(F.col("width") >= r, F.lit(r)) for r in SIZE_RULES]))
    counts = [F.count("*").alias("n"), F.sum("hit").alias("hits")]
    by_condition = test.groupBy(F.lit("condition").alias("kind"), F.col("condition").alias("name"), family).agg(*counts)
    by_band = test.groupBy(F.lit("band").alias("kind"), band.alias("name"), family).agg(*counts)
    by_rule = test.withColumn("rule", F.explode(rules)).groupBy(
        F.lit("rule").alias("kind"), F.concat(F.lit("width>="), "rule").alias("name"), family).agg(*counts)
    measured = test.agg(F.count("*").alias("all"), *[F.count_if(F.col("width") < r).alias(f"r{r}") for r in SIZE_RULES])
    abstains = measured.select(F.explode(F.array(*[F.struct(
        F.lit(f"width>={r}").alias("name"), (F.col(f"r{r}") / F.greatest("all", F.lit(1))).alias("abstains")) for r in SIZE_RULES])).alias("a")).select("a.*")
    rows = by_condition.unionByName(by_band).unionByName(by_rule)
    return rows.join(abstains, "name", "left")


def embedder_screen(scores: DataFrame, calibration: Sequence[str]) -> DataFrame:
    """Thresholds placed on the pooled calibration conditions, every condition judged by them.

    ``scores(condition, label, score, n)`` are distributions.
    """
    pooled = scores.where(F.col("condition").isin(list(calibration))).withColumn("grp", F.lit(1))
    placed = C.place_thresholds(pooled, ["grp"]).select(F.lit(1).alias("one"), "separated", "review_at", "high_at")
    ceiling = scores.agg(F.max(F.when(F.col("label") == 0, F.col("score"))).alias("ceiling")).withColumn("one", F.lit(1))
    joined = scores.withColumn("one", F.lit(1)).join(F.broadcast(placed), "one").join(F.broadcast(ceiling), "one")
    s, genuine = F.col("score"), F.col("label") == 1
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    out = joined.groupBy("condition").agg(
        F.first("review_at").alias("review_at"), F.first("high_at").alias("high_at"), F.first("separated").alias("separated"),
        count(genuine).alias("genuine"), count(~genuine).alias("impostor"), F.min(F.when(genuine, s)).alias("genuine_min"),
        F.max(F.when(~genuine, s)).alias("impostor_max"), count(genuine & (s >= F.col("high_at"))).alias("high"),
        count(genuine & (s >= F.col("review_at")) & (s < F.col("high_at"))).alias("review"), count(genuine & (s < F.col("review_at"))).alias("below"),
        count(genuine & (s > F.col("ceiling"))).alias("above_every_impostor"), count(~genuine & (s >= F.col("high_at"))).alias("impostors_high"))
    middle = C.weighted_quantiles(scores.where("label = 1").select("condition", "score", "n"), ["condition"], {"genuine_median": 0.5}).drop("n")
    curve = C.auc_eer(C.roc_points(scores, ["condition"]), ["condition"]).select("condition", "auc")
    return out.join(middle, "condition").join(curve, "condition")


def quality_guard_cost(scores: DataFrame, quality: DataFrame, high: float, penalty: float) -> DataFrame:
    """What raising the threshold for a condition's median probe quality costs in recall and saves in errors.

    ``scores(condition, label, score[, n])``, ``quality(condition, quality)`` per probe.
    """
    counted = quality.groupBy("condition", F.col("quality").alias("score")).agg(F.count("*").alias("n"))
    middle = C.weighted_quantiles(counted, ["condition"], {"p5": 0.05, "median_quality": 0.5}).drop("n")
    low = quality.groupBy("condition").agg(F.min("quality").alias("minimum"))
    raised = F.least(F.lit(1.0), F.lit(high) + penalty * F.greatest(F.lit(0.0), 1.0 - F.col("median_quality")))
    limits = checked_broadcast(cut_lineage(middle.join(low, "condition").withColumn("raised", raised)))
    weight = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    genuine = F.col("label") == 1
    count = lambda c: F.sum(F.when(c, weight).otherwise(F.lit(0))).cast("bigint")
    out = scores.join(limits, "condition").groupBy("condition", "minimum", "p5", "median_quality", "raised").agg(
        count(genuine).alias("genuine"), count(genuine & (F.col("score") >= high)).alias("kept"),
        count(genuine & (F.col("score") >= F.col("raised"))).alias("kept_guarded"),
        count(~genuine & (F.col("score") >= high)).alias("errors"), count(~genuine & (F.col("score") >= F.col("raised"))).alias("errors_guarded"))
    one = F.lit(1).cast("bigint")
    return out.withColumns({"recall": F.col("kept") / F.greatest("genuine", one), "recall_guarded": F.col("kept_guarded") / F.greatest("genuine", one)})


def impostor_tail(scores: DataFrame, keys: Sequence[str], levels: Sequence[float], high: float) -> DataFrame:
    """Upper tail of the impostor scores of each group's distribution ``(keys, label, score, n)``."""
    impostor = scores.where("label = 0")
    q = C.weighted_quantiles(impostor.select(*keys, "score", "n"), keys, {"p99": 0.99, "p999": 0.999}).drop("n")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    hits = [count((F.col("label") == 0) & (F.col("score") >= v)).alias(f"at_{int(round(v * 100)):02d}") for v in levels]
    genuine = F.col("label") == 1
    out = scores.groupBy(*keys).agg(
        count(~genuine).alias("comparisons"), F.max(F.when(~genuine, F.col("score"))).alias("impostor_max"), *hits,
        count(~genuine & (F.col("score") >= high)).alias("at_high"), count(genuine).alias("genuine"),
        (count(genuine & (F.col("score") >= high)) / F.greatest(count(genuine), F.lit(1).cast("bigint"))).alias("genuine_at_high"))
    return out.join(q, list(keys))


def _pair_peaks(level: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("identity", kind="stable"), right.sort_values("identity", kind="stable")
        la, lb = left["identity"].to_numpy(), right["identity"].to_numpy()
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
        bounds, out = group_bounds(lb), []
        for part in stripes(len(left)):
            best = np.maximum.reduceat(a[part] @ b.T, bounds, axis=1)
            rows = group_bounds(la[part])
            best = np.maximum.reduceat(best, rows, axis=0)
            r, c = np.nonzero((best >= level) & (la[part][rows][:, None] < lb[bounds][None, :]))
            out.append(pd.DataFrame({"a": la[part][rows][r], "b": lb[bounds][c], "similarity": best[r, c]}))
        return pd.concat(out)

    return run


def identity_pair_peaks(photos: DataFrame, level: float) -> DataFrame:
    """Highest similarity of every two identities that reach ``level``, folded from photos in the tasks."""
    kind = dict(photos.dtypes)["identity"]
    side = photos.select("name", "identity", "vector")
    cells = block_join(side, side, ["name"], ["name"], _pair_peaks(level), f"a {kind}, b {kind}, similarity double",
                       answers=identity_count(photos, "identity"))
    return cells.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def open_set_report(probes: DataFrame, impostors: DataFrame, limits: FaceThresholds = FaceThresholds(), tail: float = 0.3) -> DataFrame:
    """Per condition: genuine quantiles, rank-1, bands, impostor tail, wrong names, missed faces.

    ``probes(condition, genuine, impostor)`` hold the leave-one-out score and hardest rival per probe,
    both NULL where no face was found; ``impostors(condition, score, n)`` is the distribution of all
    comparisons with other identities.
    """
    g, i = F.col("genuine"), F.col("impostor")
    close = F.coalesce(F.abs(g - i) < limits.min_margin, F.lit(False))
    seen = g.isNotNull() | i.isNotNull()
    out = probes.groupBy("condition").agg(
        F.count("*").alias("probes"), F.count_if(~seen).alias("missed"), F.count("genuine").alias("scored"), F.min(g).alias("genuine_min"),
        F.count_if(g >= limits.high).alias("at_high"), F.count_if(g >= limits.candidate).alias("at_candidate"),
        F.count_if(g > F.coalesce(i, F.lit(-2.0))).alias("rank1"),
        F.count_if((i >= limits.high) & (i > F.coalesce(g, F.lit(-2.0))) & ~close).alias("named_wrong"))
    counted = probes.where(g.isNotNull()).groupBy("condition", g.alias("score")).agg(F.count("*").alias("n"))
    genuine = C.weighted_quantiles(counted, ["condition"], {"p05": 0.05, "median": 0.5}).drop("n")
    quantile = C.weighted_quantiles(impostors, ["condition"], {"impostor_p999": 0.999}).drop("n")
    above = lambda v, name: F.sum(F.when(F.col("score") >= v, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(name)
    rivals = impostors.groupBy("condition").agg(
        F.sum("n").alias("comparisons"), F.max("score").alias("impostor_max"), above(tail, "impostors_tail"),
        above(limits.candidate, "impostors_candidate"), above(limits.high, "impostors_high"))
    return out.join(genuine, "condition", "left").join(rivals, "condition", "left").join(quantile, "condition", "left")


def margin_stats(ranked: DataFrame) -> DataFrame:
    """Lead of the best over the second identity: number, minimum, first percentile and median.

    Margins are counted at six decimals, so the quantiles come from a bounded table.
    """
    margins = ranked.where(F.col("margin").isNotNull()).groupBy(F.round("margin", 6).alias("score")).agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    low = margins.groupBy("g").agg(F.min("score").alias("minimum"))
    return C.weighted_quantiles(margins, ["g"], {"p1": 0.01, "median": 0.5}).join(low, "g").select(
        F.col("n").alias("probes"), "minimum", "p1", "median")


def donor_report(fakes: DataFrame, limits: FaceThresholds = FaceThresholds()) -> DataFrame:
    """Per generator and condition: whom fakes resemble first, and how strongly their donor.

    ``fakes(model, condition, donor_score, target_score, other_score, top_role)``, scores NULL without a face.
    """
    keys = ["model", "condition"]
    d = F.col("donor_score")
    second = F.greatest("target_score", "other_score")
    named = (F.col("top_role") == "donor") & (d >= limits.high) & ~F.coalesce(d - second < limits.min_margin, F.lit(False))
    out = fakes.groupBy(*keys).agg(
        F.count("donor_score").alias("frames"), F.count_if(d.isNull()).alias("no_face"),
        F.count_if(d.isNotNull() & (F.col("top_role") == "donor")).alias("donor_first"),
        F.count_if(d.isNotNull() & (F.col("top_role") == "target")).alias("target_first"),
        F.count_if(d >= limits.high).alias("donor_high"), F.count_if(named).alias("donor_named"))
    counted = fakes.where(d.isNotNull()).groupBy(*keys, d.alias("score")).agg(F.count("*").alias("n"))
    middle = C.weighted_quantiles(counted, keys, {"median_donor": 0.5}).drop("n")
    return out.join(middle, keys, "left")


def cohort_thresholds(scores: DataFrame, margin: float = 0.01) -> DataFrame:
    """Threshold above every impostor of the fitting half, judged on the other half, per method.

    ``scores(method, calibrates, label, score, n)`` are distributions of comparisons inside each half.
    """
    fitted = scores.where("calibrates AND label = 0").groupBy("method").agg((F.max("score") + margin).alias("threshold"))
    test = scores.where("NOT calibrates").join(fitted, "method")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    genuine, above = F.col("label") == 1, F.col("score") >= F.col("threshold")
    out = test.groupBy("method", "threshold").agg(
        count(genuine).alias("genuine"), count(genuine & above).alias("kept"), count(~genuine).alias("comparisons"),
        count(~genuine & above).alias("exceedances"), F.max(F.when(~genuine, F.col("score"))).alias("impostor_max"))
    return out.withColumn("recall", F.col("kept") / F.greatest("genuine", F.lit(1).cast("bigint"))).drop("kept")


def detection_spread(detections: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, median and maximum geometry of the chosen and the other detections: one row per measure.

    ``detections(frame, chosen, ...)``; medians come from counted values, not from a gathered group.
    """
    stacked = detections.select("chosen", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("score")) for c in columns])).alias("m")).select("chosen", "m.*")
    keys = ["chosen", "measure"]
    ends = stacked.groupBy(*keys).agg(F.min("score").alias("minimum"), F.max("score").alias("maximum"))
    counted = stacked.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.count("*").alias("n"))
    return ends.join(C.weighted_quantiles(counted, keys, {"median": 0.5}), keys)


def crowded_frames(detections: DataFrame) -> DataFrame:
    """Frames, and those with more than one detection."""
    per = detections.groupBy("frame").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("frames"), F.count_if(F.col("n") > 1).alias("crowded"))


def split_half_attribution(marked: DataFrame, unmarked: DataFrame, seed: int = 0) -> DataFrame:
    """Detection thresholds from unmarked calibration images, rates and AUC on the test half.

    ``marked(image_id, score, top1)``, ``unmarked(image_id, score)`` of the same images.
    """
    names = unmarked.select(F.col("image_id").alias("person"))
    halves = split_people(names, 0.5, seed).select(F.col("person").alias("image_id"), "calibrates")
    plain = cut_lineage(unmarked.join(halves, "image_id"))
    both = cut_lineage(marked.join(halves, "image_id"))
    fit = plain.where("calibrates").groupBy("score").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    limits = C.weighted_quantiles(fit, ["g"], {"top": 1.0, "one_percent": 0.99}).select(
        F.lit(1).alias("one"), (F.col("top") + 1e-9).alias("zero_fp"), "one_percent")
    rate = lambda c, t: F.avg((F.col(c) >= F.col(t)).cast("double"))
    m = both.where("NOT calibrates").withColumn("one", F.lit(1)).join(F.broadcast(limits), "one").groupBy("one", "zero_fp", "one_percent").agg(
        F.count("*").alias("test"), rate("score", "zero_fp").alias("detection"), rate("score", "one_percent").alias("detection_1pct"),
        F.avg("top1").alias("top1"))
    u = plain.where("NOT calibrates").withColumn("one", F.lit(1)).join(F.broadcast(limits), "one").groupBy("one").agg(
        rate("score", "zero_fp").alias("false_positive"), rate("score", "one_percent").alias("false_positive_1pct"))
    table = both.where("NOT calibrates").select(F.lit(1).alias("one"), "score", F.lit(1).alias("label")).unionByName(
        plain.where("NOT calibrates").select(F.lit(1).alias("one"), "score", F.lit(0).alias("label")))
    return m.join(u, "one").join(C.rank_auc(table, ["one"]).select("one", "auc"), "one").drop("one")


def robustness_rates(rows: DataFrame) -> DataFrame:
    """Per transformation: detected, right code, wrong code, bit accuracy, quality; NULL never counts as 0.

    ``rows(transformation, detected, code, truth, bit_accuracy, psnr, ssim)``; ``truth`` is NULL for unmarked images.
    """
    wrong = F.col("detected") & ~F.col("code").eqNullSafe(F.col("truth"))
    right = F.col("detected") & F.col("code").eqNullSafe(F.col("truth"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("transformation").agg(
        F.count("*").alias("images"), share(F.col("detected")).alias("detected"), share(right).alias("code_correct"),
        share(wrong).alias("false_attribution"), F.avg("bit_accuracy").alias("bit_accuracy"), F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"),
        F.count_if(F.col("truth").isNull() & F.col("detected")).alias("unmarked_positives"))


def robustness_table(images: DataFrame, measurements: DataFrame, transformations: Mapping[str, str], threshold: float) -> DataFrame:
    """One row per image and transformation with its parameters; success is NULL where nothing was measured."""
    grid = images.select("image_id", F.explode(F.create_map(*[F.lit(x) for p in transformations.items() for x in p])).alias("transformation", "parameters"))
    return grid.join(measurements.select("image_id", "transformation", "similarity"), ["image_id", "transformation"], "left").withColumn(
        "success", F.col("similarity") >= threshold)


def _argmax(values: str) -> Column:
    """Position and value of the first maximum of an array column."""
    top = F.array_max(values)
    return F.struct((F.array_position(values, top) - 1).cast("int").alias("code"), top.alias("top"))


def layered_readings(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """What each attacked image's two decoders name, under deployed and per-attack thresholds.

    ``rows(config, attack, image_ix, truth, victim, dct_code, dct_soft, learned, psnr_vs_marked)``. Thresholds
    are the highest peaks of unmarked (config ``original``) calibration images: untouched ones for the
    ``deployed`` rule, equally attacked ones for ``per_attack``. Test rows only.
    """
    attack = F.split_part("attack", F.lit("@"), F.lit(1))
    kept = ["config", "attack", "image_ix", "truth", "victim", "dct_code", "psnr_vs_marked"]
    peaks = cut_lineage(rows.select(*kept, attack.alias("family"), _argmax("dct_soft").alias("soft"), _argmax("learned").alias("learnt")))
    held = calibration.select("image_ix").distinct()
    fit = cut_lineage(peaks.where("config = 'original'").join(held, "image_ix", "left_semi").groupBy("family").agg(
        F.max("soft.top").alias("soft_at"), F.max("learnt.top").alias("learnt_at")))
    deployed = fit.where("family = 'none'").select(F.lit(1).alias("one"), F.col("soft_at").alias("soft0"), F.col("learnt_at").alias("learnt0"))
    test = peaks.join(held, "image_ix", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(deployed), "one", "left").join(checked_broadcast(fit), "family", "left")
    infinite = F.lit(float("inf"))
    limits = lambda rule, soft, learnt: F.struct(F.lit(rule).alias("rule"), F.coalesce(*soft, infinite).alias("soft"), F.coalesce(*learnt, infinite).alias("learnt"))
    both = F.explode(F.array(limits("deployed", ["soft0"], ["learnt0"]), limits("per_attack", ["soft_at", "soft0"], ["learnt_at", "learnt0"])))
    named = lambda part: F.when(F.col(f"{part}.top") > F.col(f"limit.{part}"), F.col(f"{part}.code"))
    return test.select(*kept, "soft", "learnt", both.alias("limit")).select(
        F.col("limit.rule").alias("rule"), *kept, named("soft").alias("soft_code"), named("learnt").alias("learned_code"))


def layered_mark_cells(readings: DataFrame, has_dct: Sequence[str], has_learned: Sequence[str]) -> DataFrame:
    """Survival, wrong names, conflicts and inconclusive cases per rule, configuration and attack."""
    marked = readings.where("config <> 'original'")
    learned = F.when(F.col("config").isin(list(has_learned)), F.col("learned_code"))
    dct = F.when(F.col("config").isin(list(has_dct)), F.col("dct_code"))
    is_ = lambda code, who: F.coalesce(code == F.col(who), F.lit(False))
    not_owner = lambda code: code.isNotNull() & ~is_(code, "truth")
    outcomes = {
        "dct_owner": is_(dct, "truth"), "dct_wrong": not_owner(F.col("dct_code")), "soft_wrong": not_owner(F.col("soft_code")),
        "learned_owner": is_(learned, "truth"), "learned_wrong": not_owner(learned), "learned_victim": is_(learned, "victim"),
        "survives": is_(dct, "truth") | is_(learned, "truth"), "conflict": learned.isNotNull() & dct.isNotNull() & (learned != dct),
        "inconclusive": is_(learned, "victim") & F.col("dct_code").isNull()}
    return marked.groupBy("rule", "config", "attack").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in outcomes.items()])


def removal_cost(readings: DataFrame, rungs: Mapping[str, Sequence[str]], has_dct: Sequence[str], has_learned: Sequence[str]) -> DataFrame:
    """Per configuration and cumulative rung of attacks: images whose mark can be removed, and the median
    fidelity of the cheapest removal."""
    learned = F.when(F.col("config").isin(list(has_learned)), F.col("learned_code"))
    dct = F.when(F.col("config").isin(list(has_dct)), F.col("dct_code"))
    survives = F.coalesce(dct == F.col("truth"), F.lit(False)) | F.coalesce(learned == F.col("truth"), F.lit(False))
    allowed, members = [], []
    for rung, attacks in rungs.items():
        allowed = allowed + list(attacks)
        members.append(F.when(F.col("attack").isin(allowed), F.lit(rung)))
    test = readings.where("rule = 'deployed' AND config <> 'original'")
    images = test.select("config", "image_ix").distinct().groupBy("config").agg(F.count("*").alias("images"))
    gone = test.where(~survives & F.col("psnr_vs_marked").isNotNull()).select(
        "config", "image_ix", "psnr_vs_marked", F.explode(F.array_compact(F.array(*members))).alias("rung"))
    best = gone.groupBy("config", "rung", "image_ix").agg(F.max("psnr_vs_marked").alias("score"))
    removable = best.groupBy("config", "rung").agg(F.count("*").alias("removable"))
    middle = C.weighted_quantiles(best.groupBy("config", "rung", "score").agg(F.count("*").alias("n")), ["config", "rung"], {"median_psnr": 0.5}).drop("n")
    grid = images.select("config", "images", F.explode(F.array(*[F.lit(r) for r in rungs])).alias("rung"))
    return grid.join(removable, ["config", "rung"], "left").join(middle, ["config", "rung"], "left").withColumn(
        "removable", F.coalesce("removable", F.lit(0)))


def fit_logistic(features: DataFrame, columns: Sequence[str], share: float = 0.6, seed: int = 0) -> tuple[DataFrame, dict]:
    """Logistic regression on standardised features, people disjoint between fitting and held-out rows.

    ``features(item, identity, condition, label, ...)``; fitted on clean rows. Returns the held-out scores
    and the model (mean, scale, weights, bias), all of the feature count's size.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sides = split_people(features.select(F.col("identity").alias("person")), share, seed).select(F.col("person").alias("identity"), "calibrates")
    rows = cut_lineage(features.join(sides, "identity"))
    train = rows.where("calibrates AND condition = 'clean'")
    moments = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.count("*").alias("n")).first()
    mean = [float(moments[f"m_{c}"]) for c in columns]
    scale = [float(moments[f"s_{c}"]) if moments[f"s_{c}"] >= 1e-6 else 1.0 for c in columns]
    standard = F.array(*[(F.col(c) - m) / s for c, m, s in zip(columns, mean, scale)])
    prepared = rows.withColumn("features", array_to_vector(standard))
    model = LogisticRegression(standardization=False, regParam=1.0 / moments["n"], elasticNetParam=0.0, maxIter=200, tol=1e-8).fit(
        prepared.where("calibrates AND condition = 'clean'").select("features", F.col("label").cast("double").alias("label")))
    scored = model.transform(prepared.where("NOT calibrates").select("item", "condition", "label", "features"))
    held = scored.select("item", "condition", "label", F.get(vector_to_array("probability"), 1).alias("score"))
    return held, {"mean": mean, "scale": scale, "weights": [float(w) for w in model.coefficients], "bias": float(model.intercept)}


def usable_detector(held: DataFrame, target_precision: float = 0.95, min_auc: float = 0.75) -> DataFrame:
    """Per condition: AUC, EER, threshold for the wanted precision; usable where the clean AUC reaches the floor."""
    points = C.roc_points(held.withColumn("ord", F.col("item")), ["condition"], "ord")
    quality = C.auc_eer(points, ["condition"])
    limit = C.threshold_for_precision(held, ["condition"], target_precision).select("condition", "threshold", "precision", "tp", "fp")
    usable = quality.where("condition = 'clean'").select(F.lit(1).alias("one"), (F.col("auc") >= min_auc).alias("usable"))
    return quality.join(limit, "condition").withColumn("one", F.lit(1)).join(F.broadcast(usable), "one", "left").drop("one")


def match_controls(targets: DataFrame, pool: DataFrame, tolerance: float, seed: int = 0) -> DataFrame:
    """One unused control per target, of the same stratum and an attribute within ``tolerance``.

    ``targets(id, stratum, attribute)``, ``pool`` alike, both with unique ``id``. The attribute is cut into slices as wide as the tolerance. Inside a
    slice everything is within tolerance, so as many pairs as the rarer kind has rows are made by rank, and one kind is left.
    Then every other border between two slices, and after them the rest, is gone along once: rows of the right slice queue up, rows of the left
    one draw from the queue as long as they reach it. No round undoes what an earlier one settled, so after the three of them
    no unmatched target is within tolerance of an unmatched control. All of it is ranks and running balances over ranges: a slice or a single
    attribute with a third of all rows is work for many tasks. Targets left without a partner, also for want of a stratum or attribute, get any
    unused control (``fallback``), while the pool lasts.
    """
    side = lambda df, kind: df.select("id", "stratum", F.col("attribute").cast("double").alias("attribute"), F.lit(kind).alias("kind"))
    free = cut_lineage(side(targets, 0).unionByName(side(pool, 1)).withColumn("mix", seeded(seed, F.col("id"))))
    near = free.where("stratum IS NOT NULL AND attribute IS NOT NULL AND NOT isnan(attribute)")
    slice_of = F.col("attribute") if tolerance <= 0 else F.floor(F.col("attribute") / tolerance)
    ranked = cut_lineage(ordered_rank(near.withColumn("slice", slice_of), ["stratum", "slice", "kind"], [F.col("mix"), F.col("id")], "place"))
    cell = ["stratum", "slice", "place"]
    at = lambda rows, kind, name, keys: rows.where(f"kind = {kind}").select(*keys, F.col("id").alias(name), F.col("attribute").alias(f"{name}_attribute"))
    pairs = lambda left, right, keys: left.join(right, keys).where(F.abs(F.col("target_attribute") - F.col("control_attribute")) <= tolerance).select("target", "control")
    matched = [cut_lineage(pairs(at(ranked, 0, "target", cell), at(ranked, 1, "control", cell), cell))]
    without = lambda rows, done: rows.join(done.select(F.col("target").alias("id"), F.lit(0).alias("kind")).unionByName(
        done.select(F.col("control").alias("id"), F.lit(1).alias("kind"))), ["id", "kind"], "left_anti")
    rest = cut_lineage(without(ranked.drop("place"), matched[0]))
    for parity in (0, 1) if tolerance > 0 else ():
        border = F.floor((F.col("slice") + parity) / 2)
        right = F.pmod(F.col("slice") + parity, F.lit(2)) == 1
        # How far a row of the left slice reaches: the greatest number whose difference to it is still within tolerance.
        end = F.col("attribute") + tolerance
        reach = F.array_max(F.filter(F.array(end, end * (1 + 2.0 ** -52), end * (1 - 2.0 ** -52)), lambda v: v - F.col("attribute") <= tolerance))
        laid = rest.withColumns({"border": border, "waits": right.cast("int"), "draws": (~right).cast("int"), "at": F.when(right, F.col("attribute")).otherwise(F.coalesce(reach, end))})
        # A slice holds one kind by now. Borders between equal kinds have nothing to pair.
        kinds = laid.groupBy("stratum", "border").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").select("stratum", "border")
        queue = running_balance(laid.join(kinds, ["stratum", "border"]), ["stratum", "border"], [F.col("at"), F.col("draws"), F.col("mix"), F.col("id")], "waits", "draws")
        turn = F.when(F.col("waits") == 1, F.col("gains")).when(F.col("losses") - F.col("gains") <= F.col("missed"), F.col("losses") - F.col("missed"))
        queue = cut_lineage(queue.withColumn("turn", turn).where("turn IS NOT NULL").select("stratum", "border", "turn", "waits", "id", "kind", "attribute"))
        key = ["stratum", "border", "turn"]
        met = [pairs(at(queue.where(f"waits = {1 - first}"), 0, "target", key), at(queue.where(f"waits = {first}"), 1, "control", key), key) for first in (0, 1)]
        matched.append(cut_lineage(met[0].unionByName(met[1])))
        rest = cut_lineage(without(rest, matched[-1]))
    close = reduce(DataFrame.unionByName, matched)
    loose = ordered_rank(without(free, close), ["kind"], [F.col("mix"), F.col("id")], "place")
    late = loose.where("kind = 0").select("place", F.col("id").alias("target")).join(
        loose.where("kind = 1").select("place", F.col("id").alias("control")), "place").select("target", "control", F.lit(True).alias("fallback"))
    return close.withColumn("fallback", F.lit(False)).unionByName(late)
