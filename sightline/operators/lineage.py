"""Parent chains and connected groups, in a logarithmic number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut_lineage


def lineage_roots(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node of ``nodes(asset_id, parent_asset)`` by pointer doubling.

    Nodes whose pointer reached a root leave the working set, so a popular root is no hot join key.
    A chain that never reaches a root (a cycle, or a way into one) gets NULL root and depth.
    """
    ids = nodes.select(F.col("asset_id"))
    known = nodes.join(ids.withColumnRenamed("asset_id", "parent_asset"), "parent_asset", "left_semi")
    roots = nodes.join(known.select("asset_id"), "asset_id", "left_anti").select(
        "asset_id", F.col("asset_id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    done = cut_lineage(roots)
    active = cut_lineage(known.select("asset_id", F.col("parent_asset").alias("up"), F.lit(1).cast("bigint").alias("dist")))
    total = active.count()
    rounds = 0
    while total and rounds <= total.bit_length() + 1:
        rounds += 1
        ended = done.select(F.col("asset_id").alias("up"), "root", F.col("depth").alias("more"))
        tried = active.join(ended, "up", "left")
        finished = tried.where("root IS NOT NULL").select("asset_id", "root", (F.col("dist") + F.col("more")).alias("depth"))
        step = active.select(F.col("asset_id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        moved = tried.where("root IS NULL").select("asset_id", "up", "dist").join(step, "up").select(
            "asset_id", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"))
        done, active = cut_lineage(done.unionByName(finished)), cut_lineage(moved)
        if active.isEmpty():
            break
    lost = active.select("asset_id", F.lit(None).cast(dict(done.dtypes)["root"]).alias("root"),
                         F.lit(None).cast("bigint").alias("depth"))
    return done.unionByName(lost)


def lineage_chain(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Chain from each start (leaf) to its root: ``(start, depth, asset_id)``; a cycle is cut where it closes.

    Jumps double: a round adds to every start the ancestors twice as far away, so the number of rounds is the logarithm
    of the longest chain, without a cap. A node reached twice keeps its first depth; the walk ends when no start
    reaches a new node.
    """
    ids = nodes.select(F.col("asset_id").alias("parent_asset"))
    jumps = cut_lineage(nodes.where("parent_asset IS NOT NULL").join(ids, "parent_asset", "left_semi").select(
        F.col("asset_id").alias("at"), F.col("parent_asset").alias("to")))
    reached = cut_lineage(starts.select("asset_id").join(nodes.select("asset_id"), "asset_id", "left_semi").select(
        F.col("asset_id").alias("start"), "asset_id", F.lit(0).cast("bigint").alias("depth")))
    count, leap = reached.count(), 1
    while True:
        further = reached.join(jumps, reached["asset_id"] == jumps["at"]).select("start", F.col("to").alias("asset_id"), (F.col("depth") + leap).alias("depth"))
        reached = cut_lineage(reached.unionByName(further).groupBy("start", "asset_id").agg(F.min("depth").alias("depth")))
        now = reached.count()
        if now == count:
            return reached.select("start", F.col("depth").cast("int").alias("depth"), "asset_id")
        count, leap = now, 2 * leap
        onward = jumps.select(F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = cut_lineage(jumps.join(onward, "to").select("at", F.col("next").alias("to")))


def identity_groups(pairs: DataFrame) -> DataFrame:
    """Connected components of ``pairs(a, b)``: ``(id, group)`` with the smallest member as group.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a minimum per
    node, combined before the shuffle, joined back to the edges; no neighbour list is ever gathered.
    """
    vertices = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    joined = vertices.join(edges.select(F.col("u").alias("id"), F.col("v").alias("g")), "id", "left")
    return joined.groupBy("id").agg(F.coalesce(F.min("g"), F.first("id")).alias("group"))
