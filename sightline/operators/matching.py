"""Identity matching: who does each probe resemble, and how surely.

Inputs: ``probes(probe_id, vector, dim[, quality])`` and ``references(user_id, ref_ix, vector, dim)``.
Only vectors of equal ``dim`` are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.functions.quality import effective_thresholds
from sightline.operators.bounded import bounded_join
from sightline.operators.blocks import BLOCK_ROWS, Merge, block_join, group_bounds, stripes, unit_matrix
from sightline.operators.maxima import Enrolled, equal_pairs, leaders, matrix
from sightline.session import cut_lineage
from sightline.settings import DECISION_ORDER, EnrollmentRules, FaceThresholds


def build_templates(references: DataFrame, decimals: int | None = None) -> DataFrame:
    """One centroid per identity: normalised mean of its normalised references.

    The mean is taken position by position, so a hot identity is pre-aggregated map-side and never
    gathered; only ``dim`` sums per identity are collected into the centroid array.
    """
    unit = references.select("user_id", V.l2_normalize(F.col("vector")).alias("v"))
    parts = unit.select("user_id", F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy("user_id", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    gathered = means.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"), F.max("n").alias("image_count"))
    centroid = V.l2_normalize(F.transform("s", lambda s: s["m"]))
    if decimals is not None:
        plain = centroid
        centroid = F.transform(plain, lambda x: F.round(x, decimals))
    return gathered.select("user_id", "image_count", F.size("s").alias("dim"), centroid.alias("centroid"))


def greatest(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest entries of each row, greatest first, without sorting whole rows."""
    if k < scores.shape[1]:
        scores = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k:]
    return -np.sort(-scores, axis=1)


def _best_scores(exclude_self: bool):
    """Reducer of whole batches: the two identities with a probe's greatest similarities, and the claimed one.

    A partial maximum of an identity that is split over batches behaves like a whole one.
    """

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = (side[side["vector"].notna()] for side in (left, right))
        users, codes = np.unique(right["user_id"].to_numpy(), return_inverse=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"probe_id": left["probe_id"][:0], "user_id": users[:0], "similarity": [], "distance": []})
        order = np.argsort(codes, kind="stable")
        wanted = np.full(len(left), -1)
        if "claim" in left.columns:
            claims = left["claim"]
            wanted = np.where(claims.notna(), pd.Index(users).get_indexer(claims), -1)
        barred = np.empty(0, np.int64), np.empty(0, np.int64)
        if exclude_self:
            barred = equal_pairs(left["probe_id"], right["ref_name"].iloc[order])
        names, out = left["probe_id"].to_numpy(), []
        for r, u, similarity, distance in leaders(matrix(left["vector"]), Enrolled(matrix(right["vector"].iloc[order]), codes[order]), wanted, barred):
            out.append(pd.DataFrame({"probe_id": names[r], "user_id": users[u], "similarity": similarity, "distance": distance}))
        return pd.concat(out)

    return reduce


def _top_scores(k: int, exclude_self: bool, whole: bool = False):
    """Reducer: best ``k`` similarities per (probe, identity); identities that cannot win are left out.

    An identity wholly inside the cell competes there and only the best two survive. Only an identity too
    large for one block is split over several when ``k`` > 1; its parts may still add up, so they are kept.
    For ``k`` = 1 a partial maximum behaves like a whole one, and ``whole`` batches are compared at once.
    """
    if whole:
        return _best_scores(exclude_self)

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        users, codes = np.unique(right["user_id"].to_numpy(), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        right, codes = right.iloc[order], codes[order]
        bounds = group_bounds(codes)
        ends = np.r_[bounds[1:], len(codes)]
        whole = right["ref_count"].to_numpy()[bounds] == ends - bounds
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
        raw_a = np.vstack(left["vector"].to_numpy()).astype(np.float64)
        raw_b = np.vstack(right["vector"].to_numpy()).astype(np.float64)
        names = left["probe_id"].to_numpy()
        refs = right["ref_name"].to_numpy() if exclude_self else None
        out: list[pd.DataFrame] = []
        for part in stripes(len(left)):
            scores = a[part] @ b.T
            squares = ((raw_a[part] ** 2).sum(1)[:, None] + (raw_b ** 2).sum(1)[None, :]
                       - 2.0 * raw_a[part] @ raw_b.T)
            if exclude_self:
                mine = names[part][:, None] == refs[None, :]
                scores = np.where(mine, -np.inf, scores)
                squares = np.where(mine, np.inf, squares)
            nearest = np.minimum.reduceat(squares, bounds, axis=1)
            best = np.maximum.reduceat(scores, bounds, axis=1)
            if k == 1:
                tops = best[:, :, None]
                level, fixed = best, np.ones(len(users), bool)
            else:
                tops = np.full((scores.shape[0], len(users), k), -np.inf)
                for i, (s, e) in enumerate(zip(bounds, ends)):
                    take = min(k, e - s)
                    tops[:, i, :take] = -np.sort(np.partition(-scores[:, s:e], take - 1, axis=1)[:, :take], axis=1)
                finite = np.isfinite(tops)
                level = np.where(finite, tops, 0.0).sum(2) / np.maximum(finite.sum(2), 1)
                level = np.where(finite.any(2), level, -np.inf)
                fixed = whole
            keep = np.isfinite(best) & ~fixed[None, :]
            contest = np.where(fixed[None, :] & np.isfinite(best), level, -np.inf)
            rows = np.arange(len(contest))
            for _ in range(2):  # the first of the greatest, twice
                chosen = contest.argmax(axis=1)
                keep[rows, chosen] |= np.isfinite(contest[rows, chosen])
                contest[rows, chosen] = -np.inf
            if "claim" in left.columns:
                keep |= (left["claim"].to_numpy()[part][:, None] == users[None, :]) & np.isfinite(best)
            r, u = np.nonzero(keep)
            lists = [values[np.isfinite(values)] for values in tops[r, u]]
            out.append(pd.DataFrame({"probe_id": names[part][r], "user_id": users[u], "tops": lists,
                                     "distance": np.sqrt(np.maximum(nearest[r, u], 0.0))}))
        return pd.concat(out)

    return reduce


def _merge_top_scores(found: pd.DataFrame) -> pd.DataFrame:
    """One best similarity (a list of one) and least distance per (probe, identity)."""
    found = found.assign(tops=np.concatenate(found["tops"].to_numpy()))
    best = found.groupby(["probe_id", "user_id"], sort=False, dropna=False).agg({"tops": "max", "distance": "min"}).reset_index()
    return best.assign(tops=list(best["tops"].to_numpy()[:, None]))


def identity_scores(probes: DataFrame, references: DataFrame, strategy: str = "max", k: int = 3,
                    exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Scores of the leading identities of each probe: ``(probe_id, user_id, similarity, euclidean)``.

    Holds every identity that can be a probe's best or runner-up, and the one a probe's optional
    ``claim`` column names; others beaten twice inside their own block are left out. Ties keep the
    smallest ``user_id``. References beyond one block are cut into blocks by direction, and a probe meets only those
    that may hold one of its leading two (:mod:`sightline.operators.bounded`).
    """
    id_type = dict(probes.dtypes)["probe_id"]
    user_type = dict(references.dtypes)["user_id"]
    name = F.col("ref_name") if "ref_name" in references.columns else F.lit(None).cast(id_type)
    refs = references.select("user_id", "ref_ix", "dim", F.col("vector"), name.alias("ref_name"))
    depth = k if strategy == "topk_mean" else 1
    if strategy in ("mean", "centroid"):
        if exclude_self:
            raise ValueError("leave-one-out needs the references themselves (max or topk_mean)")
        return _scores_to_template(probes, refs, strategy)
    if depth > 1:
        counts = refs.groupBy("user_id", "dim").agg(F.count("*").alias("ref_count"))
        refs = refs.join(counts, ["user_id", "dim"])
        # An identity that fits a block stays together in one.
        spread = F.when(F.col("ref_count") > BLOCK_ROWS // 4, F.xxhash64("ref_ix")).otherwise(F.lit(0).cast("bigint"))
    else:
        refs = refs.withColumn("ref_count", F.lit(1).cast("bigint"))
        spread = F.xxhash64("ref_ix")
    refs = refs.withColumn("spread", spread)
    sides = probes.select("probe_id", "vector", "dim", *[c for c in ("claim",) if c in probes.columns]), refs
    count = references.count()
    batched = depth == 1 and count > block_rows  # within one block of references a pair of blocks is all there is
    found = "similarity double" if batched else "tops array<double>"
    schema = f"probe_id {id_type}, user_id {user_type}, {found}, distance double"

    def merged(partial: DataFrame) -> DataFrame:
        if depth == 1:
            best = F.col("similarity") if batched else F.col("tops")[0]
            return partial.groupBy("probe_id", "user_id").agg(F.max(best).alias("similarity"), F.min("distance").alias("euclidean"))
        whole = partial.groupBy("probe_id", "user_id").agg(F.flatten(F.collect_list("tops")).alias("tops"), F.min("distance").alias("euclidean"))
        return whole.select("probe_id", "user_id", V.aggregate_similarity(F.col("tops"), "topk_mean", depth).alias("similarity"), "euclidean")

    if count <= block_rows:
        merge = _merge_top_scores if depth == 1 else None
        return merged(block_join(*sides, ["probe_id"], ["user_id", "spread"], _top_scores(depth, exclude_self), schema, same=["dim"], merge=merge))
    return merged(bounded_join(*sides, _top_scores(depth, exclude_self, batched), schema, merged, block_rows, count, batched))


def _nearest_wanted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Least Euclidean distance of each probe to the references of the identities it asks for."""
    users, codes = np.unique(right["user_id"].to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    b = np.vstack(right["vector"].to_numpy()[order]).astype(np.float64)
    bounds = group_bounds(codes[order])
    a, names = np.vstack(left["vector"].to_numpy()).astype(np.float64), left["probe_id"].to_numpy()
    wanted = left["wanted"].to_numpy()
    out = []
    for part in stripes(len(left)):
        squares = (a[part] ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2.0 * a[part] @ b.T
        nearest = np.sqrt(np.maximum(np.minimum.reduceat(squares, bounds, axis=1), 0.0))
        asked = np.vstack([np.isin(users, list(w)) for w in wanted[part]])
        r, u = np.nonzero(asked)
        out.append(pd.DataFrame({"probe_id": names[part][r], "user_id": users[u], "euclidean": nearest[r, u]}))
    return pd.concat(out)


def _scores_to_template(probes: DataFrame, refs: DataFrame, strategy: str) -> DataFrame:
    """Mean and centroid need one vector per identity: the mean cosine is a product with the mean.

    A second pass measures the least distance to the references themselves, for the identities that are left.
    """
    parts = (refs.select("user_id", "dim", F.posexplode(V.l2_normalize(F.col("vector"))).alias("pos", "x"))
             .groupBy("user_id", "dim", "pos").agg(F.avg("x").alias("m"))
             .groupBy("user_id", "dim").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"))
             .select("user_id", "dim", F.transform("s", lambda s: s["m"]).alias("vector")))
    id_type, user_type = dict(probes.dtypes)["probe_id"], dict(refs.dtypes)["user_id"]
    scale_back = strategy == "mean"

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("user_id")
        users = right["user_id"].to_numpy()
        mean = np.vstack(right["vector"].to_numpy())
        lengths = np.linalg.norm(mean, axis=1) if scale_back else np.ones(len(mean))
        scores = unit_matrix(left["vector"]) @ unit_matrix(right["vector"]).T * lengths[None, :]
        keep = np.zeros(scores.shape, dtype=bool)
        np.put_along_axis(keep, np.argsort(-scores, axis=1, kind="stable")[:, :2], True, axis=1)
        if "claim" in left.columns:
            keep |= left["claim"].to_numpy()[:, None] == users[None, :]
        r, u = np.nonzero(keep)
        return pd.DataFrame({"probe_id": left["probe_id"].to_numpy()[r], "user_id": users[u], "similarity": scores[r, u]})

    claims = [c for c in ("claim",) if c in probes.columns]
    found = cut_lineage(block_join(probes.select("probe_id", "vector", "dim", *claims), parts, ["probe_id"], ["user_id"], reduce,
                                   f"probe_id {id_type}, user_id {user_type}, similarity double", same=["dim"]))
    asked = found.groupBy("probe_id").agg(F.collect_set("user_id").alias("wanted"))  # two per block of identities, and the claim
    near = block_join(probes.select("probe_id", "vector", "dim").join(asked, "probe_id"), refs.select("user_id", "ref_ix", "vector", "dim"),
                      ["probe_id"], ["user_id", "ref_ix"], _nearest_wanted, f"probe_id {id_type}, user_id {user_type}, euclidean double", same=["dim"],
                      counted=(probes, refs))
    near = near.groupBy("probe_id", "user_id").agg(F.min("euclidean").alias("euclidean"))
    return found.join(near, ["probe_id", "user_id"], "left")


def rank_identities(scores: DataFrame, limits: FaceThresholds = FaceThresholds(),
                    quality: Column | None = None) -> DataFrame:
    """Best identity per probe with runner-up, margin and decision.

    The two leaders are the first rows of an ordered window, which Spark cuts to two per task before the shuffle.
    A margin strictly below ``min_margin`` demotes the leader: never high confidence, ``ambiguous``
    while it is still a candidate. A single identity has no margin and is not demoted.
    """
    order = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "user_id", "euclidean")
    fields = ["probe_id", "user_id", "similarity", "euclidean", *([quality.alias("quality")] if quality is not None else [])]
    top = scores.select(*fields).withColumn("turn", F.row_number().over(order)).where("turn <= 2")
    at = lambda turn: F.max(F.when(F.col("turn") == turn, F.struct((-F.col("similarity")).alias("loss"), "user_id", "euclidean")))
    extra = [F.max(F.when(F.col("turn") == 1, F.col("quality"))).alias("quality")] if quality is not None else []
    leaders = top.groupBy("probe_id").agg(at(1).alias("best"), at(2).alias("second"), *extra)
    best, second = F.col("best"), F.col("second")
    q = F.col("quality") if quality is not None else F.lit(None).cast("double")
    candidate_at, high_at = effective_thresholds(q, limits)
    ranked = leaders.select(
        "probe_id", best["user_id"].alias("user_id"), (-best["loss"]).alias("similarity"),
        (-second["loss"]).alias("runner_up"), best["euclidean"].alias("euclidean"), q.alias("quality"))
    ranked = ranked.withColumn("margin", F.col("similarity") - F.col("runner_up"))
    demoted = F.coalesce(F.col("margin") < limits.min_margin, F.lit(False))
    is_candidate = F.col("similarity") >= candidate_at
    is_high = (F.col("similarity") >= high_at) & ~demoted
    return ranked.select(
        "*", is_candidate.alias("is_candidate"), is_high.alias("is_high"),
        F.when(demoted & is_candidate, "ambiguous").when(is_high, "high_confidence")
        .when(is_candidate, "candidate").otherwise("no_match").alias("decision"))


def claimed_scores(scores: DataFrame, claims: DataFrame) -> DataFrame:
    """Per ``claims(probe_id, claim)``: the claimed identity's score, and the best other identity's."""
    entry = F.struct((-F.col("similarity")).alias("loss"), "user_id")
    mine = F.col("user_id") == F.col("claim")
    out = scores.join(claims.select("probe_id", "claim"), "probe_id").groupBy("probe_id").agg(
        F.max(F.when(mine, F.col("similarity"))).alias("own_score"), F.min(F.when(~mine, entry)).alias("rival"))
    return out.select("probe_id", "own_score", (-F.col("rival.loss")).alias("impostor"),
                      F.col("rival.user_id").alias("impostor_id"))


def decision_of(similarity: Column, limits: FaceThresholds = FaceThresholds()) -> Column:
    """Decision of one score on its own (no rivals)."""
    return (F.when(similarity >= limits.high, "high_confidence")
            .when(similarity >= limits.candidate, "candidate").otherwise("no_match"))


def decision_rank(decision: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in DECISION_ORDER.items() for x in pair])
    return mapping[decision]


def match_probes(probes: DataFrame, references: DataFrame, limits: FaceThresholds = FaceThresholds(),
                 strategy: str = "max", k: int = 3) -> DataFrame:
    """Best enrolled identity of each probe. Probes without a comparable identity are not returned."""
    return rank_identities(identity_scores(probes, references, strategy, k), limits)


def skipped_identities(probes: DataFrame, references: DataFrame) -> DataFrame:
    """Per probe dimension, how many identities another embedding model makes incomparable."""
    per_dim = references.groupBy("dim").agg(F.count_distinct("user_id").alias("same"))
    everyone = references.agg(F.count_distinct("user_id").alias("enrolled"))
    dims = probes.groupBy("dim").agg(F.count("*").alias("probes"))
    joined = dims.join(per_dim, "dim", "left").withColumn("one", F.lit(1))
    return (joined.join(F.broadcast(everyone.withColumn("one", F.lit(1))), "one")
            .select("dim", "probes", (F.col("enrolled") - F.coalesce("same", F.lit(0))).alias("skipped")))


def _pair_counts(decimals: int):
    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
        la, lb = left["identity"].to_numpy(), right["identity"].to_numpy()
        na, nb = left["name"].to_numpy(), right["name"].to_numpy()
        scale, found = 10 ** decimals, []
        for part in stripes(len(left)):
            scores = a[part] @ b.T
            once = na[part][:, None] < nb[None, :]
            if not once.any():
                continue
            steps = np.rint(scores[once] * scale).astype(np.int64)
            same = (la[part][:, None] == lb[None, :])[once]
            found.append(np.unique(steps * 2 + same, return_counts=True))
        if not found:
            return pd.DataFrame({"label": [], "step": [], "n": []})
        keys = np.concatenate([f[0] for f in found])
        uniq, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([f[1] for f in found])).astype(np.int64)
        return pd.DataFrame({"label": (uniq % 2).astype(np.int32), "step": uniq // 2, "n": n})

    return reduce


def _merge_counts(found: pd.DataFrame) -> pd.DataFrame:
    """Counts of equal rows, added up."""
    return found.groupby([c for c in found.columns if c != "n"], sort=False, dropna=False)["n"].sum().reset_index()


def pair_score_counts(photos: DataFrame, decimals: int = 4) -> DataFrame:
    """Distribution of the cosine over all unordered pairs of photos: ``(label, score, n)``.

    ``photos(name, identity, vector)``. Each pair is counted once (the smaller name first); label 1
    means one identity. The table has at most 2 * (2 * 10^decimals + 1) rows whatever the input.
    """
    side = photos.select("name", "identity", "vector")
    cells = block_join(side, side, ["name"], ["name"], _pair_counts(decimals),
                       "label int, step bigint, n bigint", merge=_merge_counts)
    return (cells.groupBy("label", "step").agg(F.sum("n").alias("n"))
            .select("label", (F.col("step") / F.lit(10 ** decimals)).alias("score"), "n"))


def leave_one_out(photos: DataFrame, strategy: str = "max", k: int = 3) -> DataFrame:
    """Each photo against its own identity (without itself) and against the others.

    Returns per probe the genuine score (NULL when nothing is left to compare with) and the hardest
    impostor with its identity.
    """
    probes = photos.select(F.col("name").alias("probe_id"), "vector", F.size("vector").alias("dim"))
    refs = photos.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"),
                         F.col("name").alias("ref_name"), "vector", F.size("vector").alias("dim"))
    scores = role_scores(probes.join(photos.select(F.col("name").alias("probe_id"),
                                                   F.col("identity").alias("own")), "probe_id"),
                         refs, strategy, k)
    return scores


def _own_and_rival(k: int):
    """Reducer: per probe the best ``k`` similarities to its own identity and the best rival."""

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("user_id", kind="stable")
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
        names, own = left["probe_id"].to_numpy(), left["own"].to_numpy()
        refs, users = right["ref_name"].to_numpy(), right["user_id"].to_numpy()
        out = []
        for part in stripes(len(left)):
            scores = a[part] @ b.T
            mine = own[part][:, None] == users[None, :]
            other = names[part][:, None] != refs[None, :]
            genuine = np.where(mine & other, scores, -np.inf)
            tops = genuine.max(axis=1, keepdims=True) if k == 1 else greatest(genuine, k)
            rival = np.where(mine, -np.inf, scores)
            lead = rival.argmax(1)
            peak = rival[np.arange(len(rival)), lead]
            fair = np.isfinite(peak)
            found = np.isfinite(tops)
            lists = np.split(tops[found], np.cumsum(found.sum(axis=1))[:-1])
            out.append(pd.DataFrame({"probe_id": names[part], "tops": lists, "impostor": pd.Series(peak, dtype="object").where(fair, None),
                                     "impostor_id": pd.Series(users[lead], dtype="object").where(fair, None)}))
        return pd.concat(out)

    return reduce


def _merge_own_and_rival(k: int) -> Merge:
    """The best ``k`` of a probe's own similarities, and its best rival; of equal ones the smallest."""

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(found["probe_id"], use_na_sentinel=False)
        lengths = found["tops"].map(len).to_numpy()
        owner, tops = np.repeat(codes, lengths), np.concatenate(found["tops"].to_numpy())
        order = np.lexsort((-tops, owner))
        owner, tops = owner[order], tops[order]
        kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
        counts = np.bincount(owner[kept], minlength=len(names))
        lists = np.split(tops[kept], np.cumsum(counts)[:-1])
        rivals = found.assign(__code=codes, impostor=found["impostor"].astype("float64"), impostor_id=found["impostor_id"].astype("object")).dropna(subset=["impostor"])
        lead = rivals.sort_values(["impostor", "impostor_id"], ascending=[False, True], na_position="first").drop_duplicates("__code").set_index("__code")
        lead = lead.reindex(np.arange(len(names)))
        return pd.DataFrame({"probe_id": names, "tops": lists, "impostor": lead["impostor"].to_numpy(), "impostor_id": lead["impostor_id"].to_numpy()})

    return merge


def role_scores(probes: DataFrame, references: DataFrame, strategy: str = "max", k: int = 3) -> DataFrame:
    """Genuine score against ``own`` and hardest rival per probe; ``probes`` carries ``own``."""
    depth = k if strategy == "topk_mean" else 1
    id_type, user_type = dict(probes.dtypes)["probe_id"], dict(references.dtypes)["user_id"]
    cells = block_join(probes, references, ["probe_id"], ["user_id", "ref_ix"], _own_and_rival(depth),
                       f"probe_id {id_type}, tops array<double>, impostor double, impostor_id {user_type}",
                       same=["dim"], merge=_merge_own_and_rival(depth))
    # -id cannot be used for every type, so the smallest rival id among equal scores is taken by struct
    rival = F.struct((-F.col("impostor")).alias("loss"), F.col("impostor_id").alias("user_id"))
    merged = cells.groupBy("probe_id").agg(
        F.flatten(F.collect_list("tops")).alias("tops"),
        F.min(F.when(F.col("impostor").isNotNull(), rival)).alias("rival"))
    return (merged.join(probes.select("probe_id", "own"), "probe_id")
            .select("probe_id", "own",
                    V.aggregate_similarity(F.col("tops"), "topk_mean", depth).alias("genuine"),
                    (-F.col("rival.loss")).alias("impostor"), F.col("rival.user_id").alias("impostor_id")))


def _identity_pair_counts(decimals: int):
    """Reducer: distribution of the best score per (probe, identity), identities whole in the cell."""

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = _maxima(left, right)
        barred = left[["probe_id", "barred"]].explode("barred").dropna()
        if len(barred):
            probe_codes, user_codes = pd.Index(left["probe_id"].unique()), pd.Index(best["user_id"].unique())
            code = lambda probes, users: probe_codes.get_indexer(probes) * (len(user_codes) + 1) + user_codes.get_indexer(users) + 1
            known = barred[barred["barred"].isin(user_codes)]
            hit = np.isin(code(best["probe_id"], best["user_id"]), code(known["probe_id"], known["barred"]))
            best = best[(best["own"] == best["user_id"]).to_numpy() | ~hit]
        about = left.set_index("probe_id").loc[best["probe_id"]]
        steps = np.rint((best["similarity"].to_numpy() - about["shift"].to_numpy()) * 10 ** decimals).astype(np.int64)
        table = pd.DataFrame({"condition": about["condition"].to_numpy(), "pool": about["pool"].to_numpy(),
                              "label": (best["own"] == best["user_id"]).to_numpy().astype(np.int32), "step": steps})
        return table.groupby(["condition", "pool", "label", "step"]).size().reset_index(name="n")

    return reduce


def identity_score_counts(photos: DataFrame, decimals: int = 4, barred: DataFrame | None = None) -> DataFrame:
    """Distribution of leave-one-out probe-to-identity scores: ``(label, score, n)``.

    ``photos(name, identity, vector)`` may carry ``condition`` (a column of the result), ``pool`` (only
    photos of one pool are compared; a column of the result) and ``shift`` (taken from the probe's
    scores). The score of an identity is its best photo other than the probe. An identity that fits one
    block is hashed whole and counted inside its task; only identities too large for a block are split
    over blocks and merged as (probe, identity) maxima first. ``barred(probe_id, user_id)`` removes
    impostor comparisons (see :func:`alias_pairs`).
    """
    keys = [c for c in ("condition", "pool") if c in photos.columns]
    column = lambda c, default: F.col(c) if c in photos.columns else F.lit(default)
    full = photos.select(
        "name", "identity", "vector", F.size("vector").alias("dim"), column("condition", "").cast("string").alias("condition"),
        column("pool", "").cast("string").alias("pool"), column("shift", 0.0).cast("double").alias("shift"))
    probes = full.select(F.col("name").alias("probe_id"), F.col("identity").alias("own"), "vector", "dim", "condition", "pool", "shift")
    user_type = dict(probes.dtypes)["own"]
    none = F.array().cast(f"array<{user_type}>")
    if barred is None:
        probes = probes.withColumn("barred", none)
    else:
        lists = cut_lineage(barred.groupBy("probe_id").agg(F.collect_set("user_id").alias("barred")))  # may stem from an all-pairs join: compared once
        probes = probes.join(lists, "probe_id", "left").withColumn("barred", F.coalesce("barred", none))
    refs = full.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"), F.col("name").alias("ref_name"),
                       "vector", "dim", "pool")
    large = refs.groupBy("user_id").agg(F.count("*").alias("photos")).where(F.col("photos") > BLOCK_ROWS)
    counts = block_join(probes, refs.join(large, "user_id", "left_anti"), ["probe_id"], ["user_id"], _identity_pair_counts(decimals),
                        "condition string, pool string, label int, step bigint, n bigint", same=["dim", "pool"], merge=_merge_counts)
    if not large.isEmpty():
        split = identity_maxima(probes, refs.join(large, "user_id", "left_semi"), ["pool"])
        split = split.join(probes.select("probe_id", "barred", "condition", "shift", "pool"), "probe_id").where(
            (F.col("user_id") == F.col("own")) | ~F.array_contains("barred", F.col("user_id")))
        step = F.rint((F.col("similarity") - F.col("shift")) * F.lit(float(10 ** decimals))).cast("bigint")
        label = (F.col("user_id") == F.col("own")).cast("int")
        counts = counts.unionByName(split.groupBy("condition", "pool", label.alias("label"), step.alias("step")).agg(F.count("*").alias("n")))
    return (counts.groupBy(*keys, "label", "step").agg(F.sum("n").alias("n"))
            .select(*keys, "label", (F.col("step") / F.lit(10 ** decimals)).alias("score"), "n"))


def _maxima(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    users, codes = np.unique(right["user_id"].to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    right, codes = right.iloc[order], codes[order]
    bounds = group_bounds(codes)
    a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
    names, refs = left["probe_id"].to_numpy(), right["ref_name"].to_numpy()
    frames = []
    for part in stripes(len(left)):
        scores = np.where(names[part][:, None] == refs[None, :], -np.inf, a[part] @ b.T)
        best = np.maximum.reduceat(scores, bounds, axis=1)
        r, u = np.nonzero(np.isfinite(best))
        frames.append(pd.DataFrame({"probe_id": names[part][r], "own": left["own"].to_numpy()[part][r],
                                    "user_id": users[u], "similarity": best[r, u]}))
    return pd.concat(frames)


def _merge_maxima(found: pd.DataFrame) -> pd.DataFrame:
    return found.groupby(["probe_id", "own", "user_id"], sort=False, dropna=False)["similarity"].max().reset_index()


def identity_count(df: DataFrame, identity: str) -> int:
    """About how many identities a column holds."""
    return max(1, df.agg(F.approx_count_distinct(identity)).first()[0])


def identity_maxima(probes: DataFrame, references: DataFrame, same: list[str] | None = None) -> DataFrame:
    """Best reference per (probe, identity), a probe's own photo left out.

    One row per probe and *identity*, folded from photo pairs inside the tasks.
    """
    id_type, user_type = dict(probes.dtypes)["probe_id"], dict(references.dtypes)["user_id"]
    cells = block_join(probes, references, ["probe_id"], ["user_id", "ref_ix"], _maxima,
                       f"probe_id {id_type}, own {user_type}, user_id {user_type}, similarity double",
                       same=["dim", *(same or [])], answers=identity_count(references, "user_id"), merge=_merge_maxima)
    return cells.groupBy("probe_id", "own", "user_id").agg(F.max("similarity").alias("similarity"))


def _touching(floor: float):
    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        users, codes = np.unique(right["user_id"].to_numpy(), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        bounds = group_bounds(codes[order])
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"].iloc[order])
        names, own = left["probe_id"].to_numpy(), left["own"].to_numpy()
        out = []
        for part in stripes(len(left)):
            best = np.maximum.reduceat(a[part] @ b.T, bounds, axis=1)
            hit = (best > floor) & (own[part][:, None] != users[None, :])
            r, u = np.nonzero(hit)
            out.append(pd.DataFrame({"probe_id": names[part][r], "own": own[part][r], "user_id": users[u]}))
        return pd.concat(out)

    return reduce


def alias_pairs(photos: DataFrame, floor: float = 0.5) -> DataFrame:
    """(probe, identity) comparisons between what is one person under two names.

    A photo more similar than ``floor`` to a photo of another identity bars that identity as its
    impostor; photo pairs are folded to (photo, identity) before they leave the task.
    """
    probes = photos.select(F.col("name").alias("probe_id"), F.col("identity").alias("own"), "vector",
                           F.size("vector").alias("dim"))
    refs = photos.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"), "vector",
                         F.size("vector").alias("dim"))
    id_type, user_type = dict(probes.dtypes)["probe_id"], dict(refs.dtypes)["user_id"]
    return block_join(probes, refs, ["probe_id"], ["user_id", "ref_ix"], _touching(floor),
                      f"probe_id {id_type}, own {user_type}, user_id {user_type}", same=["dim"],
                      answers=identity_count(refs, "user_id"), merge=pd.DataFrame.drop_duplicates).distinct()


def _top_mean_partial(k: int):
    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
        names, out = left["probe_id"].to_numpy(), []
        for part in stripes(len(left)):
            tops = greatest(a[part] @ b.T, k)
            out.append(pd.DataFrame({"probe_id": names[part], "tops": list(tops)}))
        return pd.concat(out)

    return reduce


def cohort_offset(probes: DataFrame, cohort: DataFrame, k: int = 10) -> DataFrame:
    """Mean of each probe's ``k`` highest cosines to a cohort; 0 without a comparable cohort."""
    id_type = dict(probes.dtypes)["probe_id"]
    cells = block_join(probes.select("probe_id", "vector", "dim"), cohort.select("cohort_id", "vector", "dim"),
                       ["probe_id"], ["cohort_id"], _top_mean_partial(k),
                       f"probe_id {id_type}, tops array<double>", same=["dim"])
    found = cells.groupBy("probe_id").agg(F.flatten(F.collect_list("tops")).alias("tops")).select(
        "probe_id", V.aggregate_similarity(F.col("tops"), "topk_mean", k).alias("offset"))
    return (probes.select("probe_id").join(found, "probe_id", "left")
            .select("probe_id", F.coalesce("offset", F.lit(0.0)).alias("offset")))


def fuse_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two recognisers' scores per (probe, identity); a missing side or label clash raises."""
    left = a.select("probe_id", "user_id", F.col("score").alias("a"), F.col("label").alias("la"))
    right = b.select("probe_id", "user_id", F.col("score").alias("b"), F.col("label").alias("lb"))
    joined = left.join(right, ["probe_id", "user_id"], "full")
    fault = F.col("a").isNull() | F.col("b").isNull() | ~F.col("la").eqNullSafe(F.col("lb"))
    score = F.when(fault, F.raise_error(F.lit("the two score tables are not aligned")).cast("double")
                   ).otherwise((F.col("a") + F.col("b")) / 2)
    return joined.select("probe_id", "user_id", F.col("la").alias("label"), score.alias("score"))


def _swap_roles(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    right = right.sort_values("user_id", kind="stable")
    users, refs = right["user_id"].to_numpy(), right["ref_name"].to_numpy()
    a, b = unit_matrix(left["vector"]), unit_matrix(right["vector"])
    out = []
    for part in stripes(len(left)):
        rows = left.iloc[part]
        used = refs[None, :] == rows["source_name"].to_numpy()[:, None]
        scores = np.where(used, -np.inf, a[part] @ b.T)
        donor = rows["donor"].to_numpy()[:, None] == users[None, :]
        target = rows["target"].to_numpy()[:, None] == users[None, :]
        columns = {"probe_id": rows["probe_id"].to_numpy()}
        for role, mask in (("donor", donor), ("target", target), ("other", ~donor & ~target)):
            columns[f"{role}_score"] = np.where(mask, scores, -np.inf).max(1)
        out.append(pd.DataFrame(columns))
    return pd.concat(out)


def swap_roles(fakes: DataFrame, references: DataFrame) -> DataFrame:
    """Best similarity of each fake to its donor, its target and anyone else; first role wins ties.

    ``fakes(probe_id, vector, dim, donor, target, source_name)``; the photo a fake was made from
    (``source_name``) is left out of the comparison.
    """
    id_type = dict(fakes.dtypes)["probe_id"]
    cells = block_join(fakes, references, ["probe_id"], ["user_id", "ref_ix"], _swap_roles,
                       f"probe_id {id_type}, donor_score double, target_score double, other_score double",
                       same=["dim"])
    roles = ("donor", "target", "other")
    best = cells.groupBy("probe_id").agg(*[F.max(f"{r}_score").alias(f"{r}_score") for r in roles])
    top = F.greatest(*[F.col(f"{r}_score") for r in roles])
    first = F.when(F.col("donor_score") == top, "donor").when(F.col("target_score") == top, "target").otherwise("other")
    clean = lambda r: F.when(F.col(f"{r}_score") > F.lit(float("-inf")), F.col(f"{r}_score")).alias(f"{r}_score")
    return best.select("probe_id", *[clean(r) for r in roles], first.alias("top_role"))


def filter_enrollment(candidates: DataFrame, rules: EnrollmentRules = EnrollmentRules()) -> DataFrame:
    """Judge the first ``max_images`` photos of each user; adds ``reason`` (NULL = accepted) and ``enrolled``.

    ``candidates(user_id, ord, image_id, readable, confidence, face_pixels, sharpness[, refused])``.
    Everything after the first cut works on at most ``max_images`` rows per user; the cut itself is a
    ranked limit, which Spark pre-filters map-side.
    """
    first = Window.partitionBy("user_id").orderBy("ord")
    kept = candidates.withColumn("__rank", F.row_number().over(first)).where(
        F.col("__rank") <= rules.max_images).drop("__rank")
    refused = F.coalesce(F.col("refused"), F.lit(False)) if "refused" in candidates.columns else F.lit(False)
    reason = (F.when(refused, "refused").when(~F.col("readable"), "unreadable")
              .when(F.col("confidence").isNull(), "no_face")
              .when(F.col("confidence") < rules.min_confidence, "low_confidence")
              .when(F.col("face_pixels") < rules.min_face_pixels, "small_face")
              .when(F.col("sharpness") < rules.min_sharpness, "blurred"))
    user = Window.partitionBy("user_id")
    judged = kept.withColumn("reason", reason)
    middle = F.percentile(F.when(F.col("reason").isNull(), F.col("sharpness")), F.lit(0.5)).over(user)
    judged = judged.withColumn("__floor", middle * rules.min_sharpness_ratio).withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("sharpness") < F.col("__floor")), "blurrier_than_batch")
        .otherwise(F.col("reason")))
    accepted = F.sum(F.col("reason").isNull().cast("int")).over(user)
    return judged.withColumn("enrolled", accepted >= rules.min_images).drop("__floor")


def enroll_refusals(candidates: DataFrame, shielded: DataFrame) -> DataFrame:
    """Candidates that are a shielded file by bytes, or carry a shielded asset's mark code."""
    by_bytes = candidates.join(shielded.select("sha256").distinct(), "sha256", "left_semi").select(
        "image_id", F.lit("shielded file").alias("reason"), F.lit(0).alias("rank"))
    codes = shielded.where(F.col("watermark_code").isNotNull()).select("watermark_code").distinct()
    by_code = candidates.join(codes, "watermark_code", "left_semi").select(
        "image_id", F.lit("mark of a shielded asset").alias("reason"), F.lit(1).alias("rank"))
    both = by_bytes.unionByName(by_code)
    return both.groupBy("image_id").agg(F.min_by("reason", "rank").alias("reason"))
