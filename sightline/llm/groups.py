"""Connected groups of a link table, with hubs that AQE can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf


def linked_groups(links: DataFrame, shelf: Shelf) -> DataFrame:
    """``(id, group)`` for every end of ``links(a, b)``: the smallest member names the group.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges stay as they are;
    the number of rounds is logarithmic and has no cap. Every table is shelved before it is joined, so both
    sides of each join are plain shuffles and a hub with most of the edges is split at run time. Nothing but
    one count and one checksum per round reaches the driver. Links of a node to itself leave it alone.
    """
    edges = shelf.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct(), "edges")
    vertices = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    first, state = edges, None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = shelf.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = shelf.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        below = shelf.keep(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        settled = shelf.keep(small.union(below).distinct(), "edges")
        shelf.drop(low, large, below, *([] if edges is first else [edges]))
        edges = settled
    joined = vertices.join(edges.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left")
    return joined.select("id", F.coalesce("group", "id").alias("group"))
