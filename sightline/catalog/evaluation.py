"""Queries on evaluation reports: documents as items, order lines as measurements, embeddings as photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.identity import _LOO, _MAX
from sightline.catalog.inputs import UNIT, photos, probes, references
from sightline.operators import calibration as C
from sightline.functions.vectors import logistic_score
from sightline.operators import evaluation as E
from sightline.operators import matching as M
from sightline.operators.prefix import previous
from sightline.session import cut_lineage, table

r6 = lambda name: F.round(name, 6).alias(name)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evaluation items: toxic ones are fakes of the family their language names."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item"), F.col("doc_id").alias("ord"), F.when(F.col("toxic") == 1, "fake").otherwise("genuine").alias("label"),
        F.col("lang").alias("family"), F.array_distinct(F.array("source", F.concat(F.lit("src"), F.col("doc_id") % 23))).alias("people"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("shared"), "n_chars", "source")


def split_halves(spark: SparkSession, sf: str) -> DataFrame:
    return E.split_half(items(spark, sf), 0.5, 7).select("item", "half")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "n_chars")
    i = F.col("item")
    detector = F.explode(F.array(F.struct(F.lit("lengths").alias("detector"), (F.col("n_chars") % 997 / 997.0).alias("s")),
                                 F.struct(F.lit("numbers").alias("detector"), (i * 7 % 1009 / 1009.0).alias("s")))).alias("d")
    rows = base.select("item", detector).select("item", "d.*")
    both = F.explode(F.array(F.struct(F.lit("clean").alias("degradation"), F.col("s").alias("score")), F.struct(
        F.lit("jpeg50").alias("degradation"), F.when(i % 29 == 0, F.lit(float("nan"))).otherwise(F.col("s") * 0.9).alias("score")))).alias("v")
    return rows.select("detector", "item", both).select("detector", "item", "v.*")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    halved = cut_lineage(E.split_half(items(spark, sf), 0.5, 7))
    return E.judged_scores(halved, _scores(spark, sf))


def detector_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.genuine_report(_judged(spark, sf)).select("detector", "degradation", r6("threshold"), "test_photos", "false_positives", "undetected", r6("rate"), r6("upper_95"))


def detector_families(spark: SparkSession, sf: str) -> DataFrame:
    return E.family_report(_judged(spark, sf)).select("detector", "degradation", "family", r6("separation_auc"), "test_fakes", r6("recall"))


def detector_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate with its exact bounds; the second detector is taken to have seen an evaluated manifest."""
    judged = _judged(spark, sf)
    leaked = _scores(spark, sf).where("detector = 'numbers'").select("detector").distinct()
    return E.detector_gate(E.genuine_report(judged), E.family_report(judged), leaked).select("detector", "passes", F.array_join("reasons", "; ").alias("reasons"))


def condition_bands(spark: SparkSession, sf: str) -> DataFrame:
    halved = E.split_half(items(spark, sf), 0.5, 7).select("item", "label", "family", "half", "n_chars")
    rows = _scores(spark, sf).where("detector = 'lengths'").join(halved, "item").select(
        F.col("degradation").alias("condition"), "label", "family", "half", "score", (F.col("n_chars") % 120).cast("double").alias("width"))
    return E.condition_bands(rows, F.lit(0.8)).select("kind", "name", "family", "n", "hits", r6("abstains"))


def _screen_scores(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, start, size in (("full", 1, 64), ("left", 1, 32), ("right", 33, 32)):
        cut = photos(spark, sf).withColumn("vector", F.slice("vector", start, size))
        parts.append(M.identity_score_counts(cut, 3).withColumn("condition", F.lit(name)))
    return cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def embedder_screen(spark: SparkSession, sf: str) -> DataFrame:
    out = E.embedder_screen(_screen_scores(spark, sf), ["full", "left"])
    return out.select("condition", *[r6(c) for c in ("review_at", "high_at", "genuine_min", "impostor_max", "genuine_median", "auc")], "separated",
                      "genuine", "impostor", "high", "review", "below", "above_every_impostor", "impostors_high")


def quality_guard_cost(spark: SparkSession, sf: str) -> DataFrame:
    docs = items(spark, sf)
    scores = docs.select(F.col("family").alias("condition"), F.when(F.col("label") == "fake", 0).otherwise(1).alias("label"), (F.col("n_chars") % 997 / 997.0).alias("score"))
    quality = docs.select(F.col("family").alias("condition"), (F.col("n_chars") % 100 / 100.0).alias("quality"))
    return E.quality_guard_cost(scores, quality, 0.47, 0.2).select(
        "condition", *[r6(c) for c in ("minimum", "p5", "median_quality", "raised", "recall", "recall_guarded")], "errors", "errors_guarded")


def impostor_tail(spark: SparkSession, sf: str) -> DataFrame:
    aliases = M.alias_pairs(photos(spark, sf), 0.6)
    scores = M.identity_score_counts(photos(spark, sf), 4, aliases).withColumn("grp", F.lit("all"))
    out = E.impostor_tail(cut_lineage(scores), ["grp"], [0.25, 0.3, 0.35], 0.47)
    return out.select("grp", "comparisons", r6("impostor_max"), r6("p99"), r6("p999"), "at_25", "at_30", "at_35", "at_high", "genuine", r6("genuine_at_high"))


def identity_pair_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return E.identity_pair_peaks(photos(spark, sf), 0.25).select("a", "b", r6("similarity"))


def top_identity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The six most similar pairs of identities, a top-k report."""
    return E.identity_pair_peaks(photos(spark, sf), 0.25).orderBy(F.desc("similarity"), "a", "b").limit(6).select("a", "b", r6("similarity"))


def _open_probes(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.leave_one_out(photos(spark, sf))
    missed = F.col("probe_id") % 31 == 0
    return cut_lineage(rows.select(
        F.when(F.col("probe_id") % 2 == 0, "clean").otherwise("video_small").alias("condition"), "own",
        F.when(~missed, F.round("genuine", 6)).alias("genuine"), F.when(~missed, F.round("impostor", 6)).alias("impostor")))


def open_set_report(spark: SparkSession, sf: str) -> DataFrame:
    condition = F.when(F.col("name") % 2 == 0, "clean").otherwise("video_small")
    rivals = M.identity_score_counts(photos(spark, sf).withColumn("condition", condition), 4).where("label = 0").drop("label")
    return E.open_set_report(_open_probes(spark, sf), cut_lineage(rivals)).select(
        "condition", "probes", "missed", "scored", r6("genuine_min"), r6("p05"), r6("median"), "at_high", "at_candidate", "rank1",
        "comparisons", r6("impostor_max"), r6("impostor_p999"), "impostors_tail", "impostors_candidate", "impostors_high", "named_wrong")


def donor_report(spark: SparkSession, sf: str) -> DataFrame:
    """Fakes made of every embedding; generator and condition by number."""
    fakes = probes(spark, sf).select("probe_id", "vector", "dim", F.col("own").alias("donor"), ((F.col("own") + 1) % 10).alias("target"),
                                     F.col("probe_id").alias("source_name"))
    roles = M.swap_roles(fakes, references(spark, sf)).withColumns({
        "model": F.concat(F.lit("generator-"), F.col("probe_id") % 3), "condition": F.when(F.col("probe_id") % 2 == 0, "clean").otherwise("video_small")})
    lost = F.col("probe_id") % 17 == 0
    for c in ("donor_score", "target_score", "other_score"):
        roles = roles.withColumn(c, F.when(~lost, F.round(c, 6)))
    return E.donor_report(cut_lineage(roles)).select("model", "condition", "frames", "no_face", "donor_first", "target_first", "donor_high", "donor_named", r6("median_donor"))


def cohort_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    cohort = photos(spark, sf).where("identity >= 8").select(F.col("name").alias("cohort_id"), "vector", F.size("vector").alias("dim"))
    offset = M.cohort_offset(probes(spark, sf), cohort, 5).select(F.col("probe_id").alias("name"), F.col("offset").alias("shift"))
    sides = E.split_people(photos(spark, sf).select(F.col("identity").alias("person")), 0.5, 3)
    halved = photos(spark, sf).join(sides.select(F.col("person").alias("identity"), F.col("calibrates").alias("pool")), "identity").join(offset, "name")
    halved = cut_lineage(halved)
    raw = M.identity_score_counts(halved.drop("shift"), 4).withColumn("method", F.lit("raw"))
    normal = M.identity_score_counts(halved, 4).withColumn("method", F.lit("normalised"))
    scores = raw.unionByName(normal).withColumn("calibrates", F.col("pool") == "true")
    return E.cohort_thresholds(cut_lineage(scores)).select("method", r6("threshold"), "genuine", "comparisons", r6("recall"), "exceedances", r6("impostor_max"))


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") == 1).alias("chosen"), F.col("l_discount").alias("confidence"),
        F.col("l_quantity").alias("width"))


def detection_spread(spark: SparkSession, sf: str) -> DataFrame:
    return E.detection_spread(_detections(spark, sf), ["confidence", "width"]).select("chosen", "measure", "n", r6("minimum"), r6("median"), r6("maximum"))


def crowded_frames(spark: SparkSession, sf: str) -> DataFrame:
    return E.crowded_frames(_detections(spark, sf))


def split_half_attribution(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("t"))
    marked = orders.select("image_id", (F.floor(F.col("t") % 1000) / 500.0).alias("score"), (F.floor(F.col("t")) % 3 > 0).cast("double").alias("top1"))
    unmarked = orders.select("image_id", (F.floor(F.col("t") % 700) / 500.0).alias("score"))
    out = E.split_half_attribution(marked, unmarked, 5)
    return out.select("test", *[F.round(c, 6).alias(c) for c in out.columns if c != "test"])


def robustness_rates(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("l_partkey") % 5
    rows = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("transformation"), (F.col("l_quantity") > 20).alias("detected"),
        F.when(F.col("l_quantity") > 20, code).alias("code"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey") % 5).alias("truth"),
        F.when(F.col("l_suppkey") % 9 > 0, F.col("l_discount") * 10).alias("bit_accuracy"), F.col("l_tax").alias("psnr"), F.col("l_discount").alias("ssim"))
    out = E.robustness_rates(rows)
    return out.select("transformation", "images", "unmarked_positives", *[r6(c) for c in ("detected", "code_correct", "false_attribution", "bit_accuracy", "psnr", "ssim")])


# Fixed conditions of the protection comparison, with their parameters.
CONDITIONS = {"original": "{}", "watermark_only": '{"mark": true}', "adversarial_only": '{"cloak": true}', "both": '{"mark": true, "cloak": true}'}


def robustness_table(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"))
    kinds = F.array(*[F.lit(k) for k in CONDITIONS])
    measured = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.posexplode(kinds).alias("i", "transformation"), "p_size").where(
        "(image_id + i) % 6 > 0").select("image_id", "transformation", ((F.col("p_size") * (F.col("i") + 1)) % 50 / 50.0).alias("similarity"))
    return E.robustness_table(images, measured, CONDITIONS, 0.47)


def _layered(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as attacked images: the return flag is the configuration, the line number the attack."""
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    vals = lambda m: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: ((p * (c + m) + q * 3) % 101) / 101.0)
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "original").when(F.col("l_returnflag") == "N", "dct_then_learned").otherwise("learned").alias("config"),
        F.element_at(F.array(F.lit("none"), F.lit("jpeg@50"), F.lit("crop@20"), F.lit("noise@5"), F.lit("none"), F.lit("jpeg@30"), F.lit("erase@1")),
                     F.col("l_linenumber")).alias("attack"), F.col("l_orderkey").alias("image_ix"), (F.col("l_orderkey") % 8).cast("int").alias("truth"),
        ((F.col("l_orderkey") + 1) % 8).cast("int").alias("victim"), F.when(q % 3 > 0, (F.col("l_suppkey") % 8)).cast("int").alias("dct_code"),
        vals(1).alias("dct_soft"), vals(3).alias("learned"), F.col("l_extendedprice").alias("psnr_vs_marked"))
    calibration = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_ix"))
    return E.layered_readings(rows, calibration)


def layered_mark_cells(spark: SparkSession, sf: str) -> DataFrame:
    return E.layered_mark_cells(_layered(spark, sf), ["dct_then_learned"], ["dct_then_learned", "learned"])


RUNGS = {"everyday": ["none", "jpeg@50", "jpeg@30"], "editing": ["crop@20", "noise@5"], "attack": ["erase@1"]}


def removal_cost(spark: SparkSession, sf: str) -> DataFrame:
    return E.removal_cost(cut_lineage(_layered(spark, sf)), RUNGS, ["dct_then_learned"], ["dct_then_learned", "learned"]).select(
        "config", "rung", "images", "removable", r6("median_psnr"))


def _detector_features(spark: SparkSession, sf: str) -> DataFrame:
    """Length, number and quality features of every item, clean and degraded."""
    base = items(spark, sf).select("item", F.col("source").alias("identity"), (F.col("label") == "fake").cast("int").alias("label"),
                                   (F.col("n_chars") % 997 / 997.0).alias("f1"), F.log1p("n_chars").alias("f2"), (F.col("item") * 7 % 101 / 101.0).alias("f3"))
    return base.withColumn("condition", F.lit("clean")).unionByName(base.withColumn("condition", F.lit("jpeg50")).withColumn("f1", F.col("f1") * 0.9))


def logistic_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out performance of a fitted detector."""
    held, _ = E.fit_logistic(_detector_features(spark, sf), ["f1", "f2", "f3"], 0.6, 11)
    return E.usable_detector(cut_lineage(held), 0.5).select("condition", r6("auc"), r6("eer"), r6("threshold"), r6("precision"), "usable")


def logistic_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fitted model is where it should be: the gradient of its penalised loss over the fitting rows vanishes."""
    rows, names = _detector_features(spark, sf), ["f1", "f2", "f3"]
    _, model = E.fit_logistic(rows, names, 0.6, 11)
    sides = E.split_people(rows.select(F.col("identity").alias("person")), 0.6, 11).where("calibrates").select(F.col("person").alias("identity"))
    train = rows.where("condition = 'clean'").join(sides, "identity", "left_semi")
    off = logistic_score(F.array(*names), model["mean"], model["scale"], model["weights"], model["bias"]) - F.col("label")
    slopes = [F.avg(off * (F.col(c) - m) / sd) + F.lit(w) / F.count("*") for c, m, sd, w in zip(names, model["mean"], model["scale"], model["weights"])]
    found = train.agg(F.array(*slopes, F.avg(off)).alias("g"))
    return found.select(F.explode(F.arrays_zip(F.array(*map(F.lit, [*names, "bias"])).alias("name"), F.col("g"))).alias("x")).select(
        F.col("x.name").alias("name"), (F.abs(F.col("x.g")) < 1e-4).alias("settled"))


def matched_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of every third nation look for controls among the others, by segment and balance."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_acctbal") / 100).alias("attribute"), "c_nationkey")
    return E.match_controls(c.where("c_nationkey % 3 = 0"), c.where("c_nationkey % 3 > 0"), 1.0)


def matched_control_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What any right answer must satisfy: nobody twice, strata and tolerance kept, and nothing left that could still be matched."""
    pairs = cut_lineage(matched_controls(spark, sf))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_acctbal") / 100).alias("attribute"), "c_nationkey")
    side = lambda name: c.select(F.col("id").alias(name), F.col("stratum").alias(f"{name}_stratum"), F.col("attribute").alias(f"{name}_attribute"))
    joined = pairs.join(side("target"), "target").join(side("control"), "control")
    close = (F.col("target_stratum") == F.col("control_stratum")) & (F.abs(F.col("target_attribute") - F.col("control_attribute")) <= 1.0)
    counts = joined.agg(F.count("*").alias("pairs"), (F.count("*") - F.count_distinct("target")).alias("targets_twice"),
                        (F.count("*") - F.count_distinct("control")).alias("controls_twice"), F.count_if(~F.col("fallback") & ~close).alias("too_far"))
    settled = pairs.where("NOT fallback")
    free = c.join(settled.select(F.col("target").alias("id")).union(settled.select("control")), "id", "left_anti").withColumn("wants", F.col("c_nationkey") % 3 == 0)
    laid = previous(free, ["stratum"], [F.col("attribute"), F.col("id")], ["attribute", "wants"], "before")
    left = laid.where((F.col("wants") != F.col("before.wants")) & (F.col("attribute") - F.col("before.attribute") <= 1.0)).agg(F.count("*").alias("still_matchable"))
    return counts.withColumn("one", F.lit(1)).join(left.withColumn("one", F.lit(1)), "one").drop("one")


QUERIES = {f.__name__: f for f in (
    split_halves, detector_report, detector_families, detector_gate, condition_bands, embedder_screen, quality_guard_cost, impostor_tail,
    identity_pair_peaks, top_identity_pairs, open_set_report, donor_report, cohort_thresholds, detection_spread, crowded_frames,
    split_half_attribution, robustness_rates, robustness_table, layered_mark_cells, removal_cost, logistic_scores, logistic_checks, matched_controls, matched_control_checks)}

_ITEMS = """i AS (SELECT d.doc_id AS item, CASE WHEN toxic = 1 THEN 'fake' ELSE 'genuine' END AS label, lang AS family, source,
    'src' || (d.doc_id % 23) AS second, coalesce(quality, 1) = 1 AS shared, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
  person AS (SELECT source AS person FROM i UNION SELECT second FROM i),
  rk AS (SELECT person, row_number() OVER (ORDER BY md5('7:' || person), person) AS rank, count(*) OVER () AS n FROM person),
  side AS (SELECT person, rank <= round_even(n * 0.5, 0) AS cal FROM rk),
  halved AS (SELECT i.*, CASE WHEN a.cal AND b.cal THEN 'calibration' WHEN NOT a.cal AND NOT b.cal THEN 'test' ELSE 'split' END AS half
    FROM i JOIN side a ON a.person = source JOIN side b ON b.person = second)"""
_SC = f"""{_ITEMS}, d0 AS (SELECT item, 'lengths' AS detector, (n_chars % 997) / 997.0::DOUBLE AS s FROM i UNION ALL
    SELECT item, 'numbers', (item * 7 % 1009) / 1009.0::DOUBLE FROM i),
  sc AS (SELECT item, detector, 'clean' AS degradation, s AS score FROM d0 UNION ALL
    SELECT item, detector, 'jpeg50', CASE WHEN item % 29 = 0 THEN NULL ELSE s * 0.9 END FROM d0),
  lim AS (SELECT detector, quantile_cont(score, 0.995) AS threshold FROM sc JOIN halved USING (item) WHERE degradation = 'clean'
    AND half = 'calibration' AND label = 'genuine' GROUP BY 1),
  j AS (SELECT * FROM sc JOIN halved USING (item) JOIN lim USING (detector))"""
# The exact bound is where the binomial distribution function falls to 2.5 %; found by bisection.
_BOUND = """rep AS (SELECT detector, degradation, any_value(threshold) AS threshold, count(score) AS test_photos, count(*) FILTER (WHERE score >= threshold) AS false_positives,
    count(*) FILTER (WHERE score IS NULL) AS undetected FROM j WHERE half = 'test' AND label = 'genuine' GROUP BY ALL),
  bis(k, n, lo, hi, turn) AS (SELECT DISTINCT false_positives, test_photos, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM rep WHERE test_photos > 0 UNION ALL
    SELECT k, n, CASE WHEN below > 0.025 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below > 0.025 THEN hi ELSE (lo + hi) / 2 END, turn + 1
    FROM (SELECT *, list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln((lo + hi) / 2)
      + (n - x) * ln(1 - (lo + hi) / 2)))) AS below FROM bis WHERE turn < 60) z),
  bounded AS (SELECT rep.*, CASE WHEN false_positives = test_photos THEN 1.0 ELSE lo END AS upper_95 FROM rep LEFT JOIN bis ON k = false_positives AND n = test_photos AND turn = 60)"""
_LAYER = """r AS (SELECT CASE l_returnflag WHEN 'A' THEN 'original' WHEN 'N' THEN 'dct_then_learned' ELSE 'learned' END AS config,
    ['none', 'jpeg@50', 'crop@20', 'noise@5', 'none', 'jpeg@30', 'erase@1'][l_linenumber] AS attack, l_orderkey AS ix, l_orderkey % 8 AS truth,
    (l_orderkey + 1) % 8 AS victim, CASE WHEN l_quantity::INT % 3 > 0 THEN l_suppkey % 8 END AS dct,
    list_transform(range(8), lambda c: ((l_partkey * (c + 1) + l_quantity::INT * 3) % 101) / 101) AS soft,
    list_transform(range(8), lambda c: ((l_partkey * (c + 3) + l_quantity::INT * 3) % 101) / 101) AS learnt, l_extendedprice AS psnr FROM lineitem),
  f AS (SELECT r.*, string_split(attack, '@')[1] AS fam, ix IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS held,
    list_max(soft) AS st, list_position(soft, list_max(soft)) - 1 AS sc, list_max(learnt) AS lt, list_position(learnt, list_max(learnt)) - 1 AS lc FROM r),
  fit AS (SELECT fam, max(st) AS sa, max(lt) AS la FROM f WHERE config = 'original' AND held GROUP BY 1),
  t AS (SELECT rule, f.*, coalesce(CASE WHEN rule = 'per_attack' THEN fit.sa END, d.sa) AS s_at, coalesce(CASE WHEN rule = 'per_attack' THEN fit.la END, d.la) AS l_at
    FROM f CROSS JOIN (VALUES ('deployed'), ('per_attack')) u(rule) LEFT JOIN fit ON fit.fam = f.fam LEFT JOIN fit d ON d.fam = 'none' WHERE NOT held),
  n AS (SELECT *, CASE WHEN st > s_at THEN sc END AS soft_code, CASE WHEN lt > l_at THEN lc END AS learned_code,
    CASE WHEN config = 'dct_then_learned' THEN dct END AS own_dct FROM t WHERE config <> 'original')"""

ORACLES = {
    "logistic_checks": "SELECT name, (SELECT count(*) FROM documents) > 0 AS settled FROM (VALUES ('f1'), ('f2'), ('f3'), ('bias')) t(name)",
    "matched_control_checks": """SELECT least(count(*) FILTER (WHERE c_nationkey % 3 = 0), count(*) FILTER (WHERE c_nationkey % 3 > 0)) AS pairs, 0::BIGINT AS targets_twice,
      0::BIGINT AS controls_twice, 0::BIGINT AS too_far, 0::BIGINT AS still_matchable FROM customer""",
    "split_halves": f"WITH {_ITEMS} SELECT item, half FROM halved",
    "detector_report": f"""WITH RECURSIVE {_SC}, {_BOUND} SELECT detector, degradation, round(threshold, 6) AS threshold, test_photos, false_positives, undetected,
      round(false_positives / greatest(test_photos, 1), 6) AS rate, round(upper_95, 6) AS upper_95 FROM bounded""",
    "detector_gate": f"""WITH RECURSIVE {_SC}, {_BOUND}, fam AS (SELECT DISTINCT detector, family FROM sc, i WHERE label = 'fake'),
      rc AS (SELECT detector, family, avg((score >= threshold)::INT) AS recall FROM j WHERE label = 'fake' AND half = 'test' AND degradation = 'clean'
        AND score IS NOT NULL GROUP BY ALL),
      why AS (SELECT detector, degradation || ': false-positive bound too high' AS reason FROM bounded WHERE upper_95 IS NULL OR upper_95 > 0.01 UNION
        SELECT detector, family || ': recall too low' FROM fam LEFT JOIN rc USING (detector, family) WHERE coalesce(recall, 0) < 0.2 UNION
        SELECT 'numbers', 'trained on an evaluated manifest')
      SELECT d.detector, count(reason) = 0 AS passes, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reasons
      FROM (SELECT DISTINCT detector FROM bounded) d LEFT JOIN why ON why.detector = d.detector GROUP BY 1""",
    "detector_families": f"""WITH {_SC}, fam AS (SELECT DISTINCT family AS fam FROM i WHERE label = 'fake'),
      m AS (SELECT detector, degradation, fam, item, score, (label = 'fake')::INT AS y, half FROM j, fam WHERE score IS NOT NULL
      AND ((label = 'fake' AND family = fam) OR (label = 'genuine' AND shared))),
      c AS (SELECT *, sum(y) OVER (PARTITION BY detector, degradation, fam ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS tp FROM m),
      a AS (SELECT detector, degradation, fam, sum(CASE WHEN y = 0 THEN tp END) / (sum(y) * sum(1 - y)) AS auc FROM c GROUP BY ALL),
      f AS (SELECT detector, degradation, family AS fam, count(*) AS n, avg((score >= threshold)::INT) AS recall FROM j WHERE label = 'fake' AND half = 'test'
      AND score IS NOT NULL GROUP BY ALL) SELECT a.detector, a.degradation, a.fam AS family, round(auc, 6) AS separation_auc, coalesce(n, 0) AS test_fakes,
      round(recall, 6) AS recall FROM a LEFT JOIN f ON f.detector = a.detector AND f.degradation = a.degradation AND f.fam = a.fam""",
    "condition_bands": f"""WITH {_SC}, k AS (SELECT degradation, CASE WHEN label = 'fake' THEN family END AS family, score >= 0.8 AS hit, n_chars % 120 AS w
      FROM j WHERE detector = 'lengths' AND half = 'test' AND score IS NOT NULL),
      ab AS (SELECT v, count(*) FILTER (WHERE w < v) / count(*) AS abstains FROM k, (VALUES (64), (80), (96)) r(v) GROUP BY v)
      SELECT 'condition' AS kind, degradation AS name, family, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, NULL::DOUBLE AS abstains FROM k GROUP BY ALL UNION ALL
      SELECT 'band', CASE WHEN w < 48 THEN '0-48' WHEN w < 64 THEN '48-64' WHEN w < 80 THEN '64-80' WHEN w < 96 THEN '80-96' ELSE '96-' END, family, count(*),
      count(*) FILTER (WHERE hit), NULL FROM k GROUP BY ALL UNION ALL
      SELECT 'rule', 'width>=' || v, family, count(*), count(*) FILTER (WHERE hit), round(any_value(abstains), 6) FROM k JOIN ab ON w >= v GROUP BY 2, 3""",
    "embedder_screen": """WITH h(condition, a, b) AS (VALUES ('full', 1, 64), ('left', 1, 32), ('right', 33, 64)),
      w AS (SELECT condition, vec_id, label, list_slice(embedding::DOUBLE[], a, b) AS w FROM embeddings, h),
      u AS (SELECT condition, vec_id, label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM w),
      s AS (SELECT a.condition, a.vec_id, (a.label = b.label)::INT AS y, round(max(list_dot_product(a.v, b.v)) * 1000)::BIGINT / 1000 AS score FROM u a JOIN u b
      ON a.condition = b.condition AND a.vec_id <> b.vec_id GROUP BY a.condition, a.vec_id, a.label, b.label),
      g AS (SELECT min(CASE WHEN y = 1 THEN score END) AS lo, max(CASE WHEN y = 0 THEN score END) AS hi FROM s WHERE condition IN ('full', 'left')),
      t AS (SELECT (lo + hi) / 2 - abs(lo - hi) / 4 AS review_at, (lo + hi) / 2 + abs(lo - hi) / 4 AS high_at, lo > hi AS separated FROM g),
      c AS (SELECT max(score) AS top FROM s WHERE y = 0),
      d AS (SELECT condition, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
      cum AS (SELECT *, sum(pos) OVER (PARTITION BY condition ORDER BY score DESC) AS tp FROM d),
      auc AS (SELECT condition, sum(neg * (2 * tp - pos)) / (2.0 * sum(pos) * sum(neg)) AS auc FROM cum GROUP BY 1)
      SELECT s.condition, round(any_value(review_at), 6) AS review_at, round(any_value(high_at), 6) AS high_at, any_value(separated) AS separated,
      round(min(CASE WHEN y = 1 THEN score END), 6) AS genuine_min, round(max(CASE WHEN y = 0 THEN score END), 6) AS impostor_max,
      round(quantile_cont(CASE WHEN y = 1 THEN score END, 0.5), 6) AS genuine_median, round(any_value(auc), 6) AS auc,
      count(*) FILTER (WHERE y = 1) AS genuine, count(*) FILTER (WHERE y = 0) AS impostor, count(*) FILTER (WHERE y = 1 AND score >= high_at) AS high,
      count(*) FILTER (WHERE y = 1 AND score >= review_at AND score < high_at) AS review, count(*) FILTER (WHERE y = 1 AND score < review_at) AS below,
      count(*) FILTER (WHERE y = 1 AND score > top) AS above_every_impostor, count(*) FILTER (WHERE y = 0 AND score >= high_at) AS impostors_high
      FROM s CROSS JOIN t CROSS JOIN c JOIN auc ON auc.condition = s.condition GROUP BY s.condition""",
    "quality_guard_cost": f"""WITH {_ITEMS}, k AS (SELECT family AS condition, label = 'genuine' AS y, (n_chars % 997) / 997.0::DOUBLE AS s, (n_chars % 100) / 100 AS q FROM i),
      m AS (SELECT condition, min(q) AS minimum, quantile_cont(q, 0.05) AS p5, quantile_cont(q, 0.5) AS med FROM k GROUP BY 1),
      z AS (SELECT *, least(1.0, 0.47 + 0.2 * greatest(0.0, 1.0 - med)) AS raised FROM m)
      SELECT k.condition, round(any_value(minimum), 6) AS minimum, round(any_value(p5), 6) AS p5, round(any_value(med), 6) AS median_quality,
      round(any_value(raised), 6) AS raised, round(count(*) FILTER (WHERE y AND s >= 0.47) / greatest(count(*) FILTER (WHERE y), 1), 6) AS recall,
      round(count(*) FILTER (WHERE y AND s >= raised) / greatest(count(*) FILTER (WHERE y), 1), 6) AS recall_guarded,
      count(*) FILTER (WHERE NOT y AND s >= 0.47) AS errors, count(*) FILTER (WHERE NOT y AND s >= raised) AS errors_guarded
      FROM k JOIN z ON z.condition = k.condition GROUP BY k.condition""",
    "impostor_tail": f"""WITH {_MAX}, k AS (SELECT own = user_id AS y, round(similarity * 1e4)::BIGINT / 10000 AS s FROM p WHERE own = user_id OR similarity <= 0.6)
      SELECT 'all' AS grp, count(*) FILTER (WHERE NOT y) AS comparisons, round(max(CASE WHEN NOT y THEN s END), 6) AS impostor_max,
      round(quantile_cont(CASE WHEN NOT y THEN s END, 0.99), 6) AS p99, round(quantile_cont(CASE WHEN NOT y THEN s END, 0.999), 6) AS p999,
      count(*) FILTER (WHERE NOT y AND s >= 0.25) AS at_25, count(*) FILTER (WHERE NOT y AND s >= 0.3) AS at_30, count(*) FILTER (WHERE NOT y AND s >= 0.35) AS at_35,
      count(*) FILTER (WHERE NOT y AND s >= 0.47) AS at_high, count(*) FILTER (WHERE y) AS genuine,
      round(count(*) FILTER (WHERE y AND s >= 0.47) / greatest(count(*) FILTER (WHERE y), 1), 6) AS genuine_at_high FROM k""",
    "identity_pair_peaks": f"""WITH {_MAX} SELECT least(own, user_id) AS a, greatest(own, user_id) AS b, round(max(similarity), 6) AS similarity FROM p
      WHERE own <> user_id GROUP BY 1, 2 HAVING max(similarity) >= 0.25""",
    "top_identity_pairs": f"""WITH {_MAX}, k AS (SELECT least(own, user_id) AS a, greatest(own, user_id) AS b, max(similarity) AS s FROM p WHERE own <> user_id
      GROUP BY 1, 2 HAVING max(similarity) >= 0.25) SELECT a, b, round(s, 6) AS similarity FROM k ORDER BY s DESC, a, b LIMIT 6""",
    "open_set_report": f"""WITH {_LOO}, k AS (SELECT CASE WHEN probe_id % 2 = 0 THEN 'clean' ELSE 'video_small' END AS condition,
      CASE WHEN probe_id % 31 > 0 THEN round(genuine, 6) END AS g, CASE WHEN probe_id % 31 > 0 THEN round(impostor, 6) END AS i FROM best),
      a AS (SELECT condition, count(*) AS probes, count(*) FILTER (WHERE g IS NULL AND i IS NULL) AS missed, count(g) AS scored, min(g) AS genuine_min,
      round(quantile_cont(g, 0.05), 6) AS p05, round(quantile_cont(g, 0.5), 6) AS median, count(*) FILTER (WHERE g >= 0.47) AS at_high,
      count(*) FILTER (WHERE g >= 0.3591) AS at_candidate, count(*) FILTER (WHERE g > i) AS rank1,
      count(*) FILTER (WHERE i >= 0.47 AND i > g AND NOT abs(g - i) < 0.05) AS named_wrong FROM k GROUP BY 1),
      r AS (SELECT CASE WHEN probe_id % 2 = 0 THEN 'clean' ELSE 'video_small' END AS condition, round(similarity * 1e4)::BIGINT / 10000 AS s FROM p WHERE own <> user_id),
      b AS (SELECT condition, count(*) AS comparisons, round(max(s), 6) AS impostor_max, round(quantile_cont(s, 0.999), 6) AS impostor_p999,
      count(*) FILTER (WHERE s >= 0.3) AS impostors_tail, count(*) FILTER (WHERE s >= 0.3591) AS impostors_candidate,
      count(*) FILTER (WHERE s >= 0.47) AS impostors_high FROM r GROUP BY 1) SELECT * FROM a JOIN b USING (condition)""",
    "donor_report": f"""WITH {_MAX}, r AS (SELECT probe_id, round(max(CASE WHEN user_id = own THEN similarity END), 6) AS d,
      round(max(CASE WHEN user_id = (own + 1) % 10 THEN similarity END), 6) AS t, round(max(CASE WHEN user_id NOT IN (own, (own + 1) % 10) THEN similarity END), 6) AS o
      FROM p GROUP BY probe_id), k AS (SELECT 'generator-' || (probe_id % 3) AS model, CASE WHEN probe_id % 2 = 0 THEN 'clean' ELSE 'video_small' END AS condition,
      CASE WHEN probe_id % 17 > 0 THEN d END AS d, t, o FROM r)
      SELECT model, condition, count(d) AS frames, count(*) FILTER (WHERE d IS NULL) AS no_face, count(*) FILTER (WHERE d >= t AND d >= o) AS donor_first,
      count(*) FILTER (WHERE d IS NOT NULL AND t > d AND t >= o) AS target_first, count(*) FILTER (WHERE d >= 0.47) AS donor_high,
      count(*) FILTER (WHERE d >= t AND d >= o AND d >= 0.47 AND d - greatest(t, o) >= 0.05) AS donor_named, round(quantile_cont(d, 0.5), 6) AS median_donor
      FROM k GROUP BY ALL""",
    "cohort_thresholds": f"""WITH {_MAX}, k AS (SELECT a.vec_id AS probe_id, list_dot_product(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_dot_product(a.v, b.v) DESC) AS rk FROM u a JOIN u b ON b.label >= 8), o AS (SELECT probe_id, avg(c) AS shift FROM k WHERE rk <= 5 GROUP BY 1),
      pr AS (SELECT DISTINCT own AS person FROM p), sd AS (SELECT person, row_number() OVER (ORDER BY md5('3:' || person), person)
      <= round_even((SELECT count(*) FROM pr) * 0.5, 0) AS cal FROM pr),
      h AS (SELECT p.*, a.cal, shift FROM p JOIN sd a ON a.person = own JOIN sd b ON b.person = user_id AND a.cal = b.cal JOIN o USING (probe_id)),
      m AS (SELECT 'raw' AS method, cal, own = user_id AS y, round(similarity * 1e4)::BIGINT / 10000 AS s FROM h UNION ALL
      SELECT 'normalised', cal, own = user_id, round((similarity - shift) * 1e4)::BIGINT / 10000 FROM h),
      f AS (SELECT method, max(s) + 0.01 AS threshold FROM m WHERE cal AND NOT y GROUP BY 1)
      SELECT method, round(any_value(threshold), 6) AS threshold, count(*) FILTER (WHERE y) AS genuine, count(*) FILTER (WHERE NOT y) AS comparisons,
      round(count(*) FILTER (WHERE y AND s >= threshold) / greatest(count(*) FILTER (WHERE y), 1), 6) AS recall,
      count(*) FILTER (WHERE NOT y AND s >= threshold) AS exceedances, round(max(CASE WHEN NOT y THEN s END), 6) AS impostor_max
      FROM m JOIN f USING (method) WHERE NOT cal GROUP BY method""",
    "detection_spread": """WITH m AS (SELECT l_linenumber = 1 AS chosen, 'confidence' AS measure, l_discount AS v FROM lineitem UNION ALL
      SELECT l_linenumber = 1, 'width', l_quantity FROM lineitem) SELECT chosen, measure, count(*) AS n, round(min(v), 6) AS minimum,
      round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS maximum FROM m GROUP BY ALL""",
    "crowded_frames": """WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS frames,
      count(*) FILTER (WHERE n > 1) AS crowded FROM p""",
    "split_half_attribution": """WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice % 1000) / 500 AS m, floor(o_totalprice % 700) / 500 AS u,
      (floor(o_totalprice)::BIGINT % 3 > 0)::INT AS top1, row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) AS rk, count(*) OVER () AS n FROM orders),
      h AS (SELECT *, rk <= round_even(n * 0.5, 0) AS cal FROM o), t AS (SELECT max(u) + 1e-9 AS z, quantile_cont(u, 0.99) AS one FROM h WHERE cal),
      d AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM (SELECT m AS s, 1 AS y FROM h WHERE NOT cal UNION ALL SELECT u, 0 FROM h WHERE NOT cal) GROUP BY 1),
      c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp FROM d), a AS (SELECT sum(neg * (2 * tp - pos)) / (2.0 * sum(pos) * sum(neg)) AS auc FROM c)
      SELECT count(*) AS test, round(any_value(z), 6) AS zero_fp, round(any_value(one), 6) AS one_percent, round(avg((m >= z)::INT), 6) AS detection,
      round(avg((m >= one)::INT), 6) AS detection_1pct, round(avg(top1), 6) AS top1, round(avg((u >= z)::INT), 6) AS false_positive,
      round(avg((u >= one)::INT), 6) AS false_positive_1pct, round(any_value(auc), 6) AS auc FROM h, t, a WHERE NOT cal""",
    "robustness_rates": """WITH k AS (SELECT l_returnflag || '-' || l_linestatus AS transformation, l_quantity > 20 AS d, l_partkey % 5 AS code,
      CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 5 END AS truth, l_discount, l_tax FROM lineitem)
      SELECT transformation, count(*) AS images, count(*) FILTER (WHERE truth IS NULL AND d) AS unmarked_positives, round(avg(d::INT), 6) AS detected,
      round(avg((d AND code IS NOT DISTINCT FROM truth)::INT), 6) AS code_correct, round(avg((d AND code IS DISTINCT FROM truth)::INT), 6) AS false_attribution,
      round(avg(CASE WHEN truth IS NOT NULL THEN l_discount * 10 END), 6) AS bit_accuracy, round(avg(l_tax), 6) AS psnr, round(avg(l_discount), 6) AS ssim
      FROM k GROUP BY 1""",
    "robustness_table": """WITH c(i, transformation, parameters) AS (VALUES (0, 'original', '{}'), (1, 'watermark_only', '{"mark": true}'),
      (2, 'adversarial_only', '{"cloak": true}'), (3, 'both', '{"mark": true, "cloak": true}')),
      k AS (SELECT p_partkey AS image_id, transformation, parameters, CASE WHEN (p_partkey + i) % 6 > 0 THEN ((p_size * (i + 1)) % 50) / 50 END AS similarity FROM part, c)
      SELECT *, similarity >= 0.47 AS success FROM k""",
    "layered_mark_cells": f"""WITH {_LAYER} SELECT rule, config, attack, count(*) AS n, count(*) FILTER (WHERE own_dct = truth) AS dct_owner,
      count(*) FILTER (WHERE dct <> truth) AS dct_wrong, count(*) FILTER (WHERE soft_code <> truth) AS soft_wrong,
      count(*) FILTER (WHERE learned_code = truth) AS learned_owner, count(*) FILTER (WHERE learned_code <> truth) AS learned_wrong,
      count(*) FILTER (WHERE learned_code = victim) AS learned_victim,
      count(*) FILTER (WHERE own_dct = truth OR learned_code = truth) AS survives, count(*) FILTER (WHERE own_dct <> learned_code) AS conflict,
      count(*) FILTER (WHERE learned_code = victim AND dct IS NULL) AS inconclusive FROM n GROUP BY ALL""",
    "removal_cost": f"""WITH {_LAYER}, g AS (SELECT config, ix, psnr, attack FROM n WHERE rule = 'deployed' AND NOT coalesce(own_dct = truth, false)
      AND NOT coalesce(learned_code = truth, false)), w(rung, attacks) AS (VALUES ('everyday', ['none', 'jpeg@50', 'jpeg@30']),
      ('editing', ['none', 'jpeg@50', 'jpeg@30', 'crop@20', 'noise@5']), ('attack', ['none', 'jpeg@50', 'jpeg@30', 'crop@20', 'noise@5', 'erase@1'])),
      b AS (SELECT config, rung, ix, max(psnr) AS p FROM g JOIN w ON list_contains(attacks, attack) GROUP BY ALL),
      im AS (SELECT config, count(DISTINCT ix) AS images FROM n WHERE rule = 'deployed' GROUP BY 1)
      SELECT im.config, w.rung, any_value(images) AS images, count(ix) AS removable, round(quantile_cont(p, 0.5), 6) AS median_psnr
      FROM im CROSS JOIN w LEFT JOIN b ON b.config = im.config AND b.rung = w.rung GROUP BY im.config, w.rung""",
}
