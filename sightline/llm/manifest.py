"""A sealed manifest: every item a leaf of its source's hash tree, the sources' roots leaves of one more, and each item with its proof.

Items are ranked inside their source, and the rank's base-16 digits become columns. Inside a block of ``FAN_OUT ** DIGITS`` leaves
the digits are grouped away one after another, the children nested as structs in their parent, so a block is one row of bounded size
after one exchange. The blocks' own digests are ranked leaves of the next tier, until one node is left per tree. Proofs come back down by
transform and explode: a block's row holds every sibling that its leaves need, and what lies above it reaches it as one
more row of its group. Nothing is joined on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf
from sightline.operators.prefix import ordered_rank

FAN_OUT_BITS = 4  # sixteen nodes have one parent
DIGITS = 3  # of a rank inside one block: 4,096 leaves
FOREST = "all"  # the tree of the sources' roots


def framed(*fields: Column) -> Column:
    """Fields one after another, so that no two different rows look alike: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def item_digest(*fields: Column) -> Column:
    """An item's leaf: lowercase hex SHA-256 of its framed fields."""
    return F.sha2(framed(*fields), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof ``steps ARRAY<STRUCT<before, after>>`` lead to; it equals the sealed root only for the sealed leaf."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings(steps: Column) -> Column:
    """All sibling digests of a proof in a row, level by level from the leaf, left to right."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["before"], step["after"])), "")


def joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda child: child["digest"]), "")


def parent(children: Column, number: Column) -> Column:
    """The digest above some consecutive children; an only child that begins its level has nothing beside it and stays the root."""
    return F.when((F.size(children) > 1) | (number > 0), F.sha2(joined(children), 256)).otherwise(children[0]["digest"])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``(tree, block, digest, children)`` of ``nodes(tree, rank, digest, item)``: the digits of the rank are grouped away inside each block."""
    digit = lambda level: F.shiftright("rank", FAN_OUT_BITS * level).bitwiseAND((1 << FAN_OUT_BITS) - 1).cast("int")
    names = [f"digit_{level}" for level in range(DIGITS)]
    rows = nodes.select("tree", F.shiftright("rank", FAN_OUT_BITS * DIGITS).alias("block"), *[digit(i).alias(n) for i, n in enumerate(names)], "digest", "item")
    rows = rows.repartition("tree", "block")  # finer groups below need no further exchange
    held = ["digest", "item"]
    for level, name in enumerate(names):
        keys = ["tree", "block", *names[:level:-1]]  # the digits that are left
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, *held))).alias("children"))
        number = F.col("block")
        for left in names[:level:-1]:
            number = F.shiftleft(number, FAN_OUT_BITS) + F.col(left)
        rows = rows.withColumn("digest", parent(F.col("children"), number))
        held = ["digest", "children"]
    return rows.select("tree", "block", "digest", "children")


def handed_down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``(tree, rank, digest, item, steps, subroot, root)`` of every node in ``blocks``, whose own proofs ``above(tree, block, steps, subroot, root)`` holds.

    A block and its proof meet in one group of two rows; each explode then adds one level's siblings.
    """
    proof = F.struct("steps", "subroot", "root").alias("proof")
    two = blocks.select("tree", "block", "children", F.lit(None).cast(above.select(proof).schema["proof"].dataType).alias("proof")).unionByName(
        above.select("tree", "block", F.lit(None).cast(blocks.schema["children"].dataType).alias("children"), proof))
    met = two.groupBy("tree", "block").agg(F.first("children", ignorenulls=True).alias("children"), F.first("proof", ignorenulls=True).alias("proof"))
    rows = met.select("tree", F.col("block").alias("number"), "children", "proof.*")
    for level in reversed(range(DIGITS)):
        hashed = (F.size("children") > 1) | (F.col("number") > 0)
        digests = F.transform("children", lambda child: child["digest"])
        beside = lambda i: F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"), F.array_join(F.slice(digests, i + 2, F.lit(1 << FAN_OUT_BITS)), "").alias("after"))
        each = F.transform("children", lambda child, i: F.struct(child.alias("child"), F.when(hashed, F.array(beside(i))).otherwise(F.array().cast("array<struct<before:string,after:string>>")).alias("own")))
        rows = rows.select("tree", "number", F.explode(each).alias("e"), "steps", "subroot", "root").select(
            "tree", (F.shiftleft("number", FAN_OUT_BITS) + F.col(f"e.child.digit_{level}")).alias("number"), "e.child.*", F.concat("e.own", "steps").alias("steps"), "subroot", "root")
    return rows.select("tree", F.col("number").alias("rank"), "digest", "item", "steps", "subroot", "root")


def tiers_of(nodes: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """The blocks of every tier, from the leaves to one block per tree."""
    tiers = []
    while True:
        blocks = shelf.keep(rolled_up(nodes), f"tier-{len(tiers)}")
        tiers.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return tiers
        nodes = blocks.select("tree", F.col("block").alias("rank"), "digest", F.lit(None).cast("int").alias("item"))


def proven(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Proofs of the leaves in the lowest tier; ``tops(tree, steps, subroot, root)`` says what lies above each tree."""
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    for blocks in reversed(tiers):
        nodes = handed_down(blocks, above)
        above = nodes.select("tree", F.col("rank").alias("block"), "steps", "subroot", "root")
    return nodes


def seal_manifest(items: DataFrame, fields: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """``(uri, source, <carried>, leaf, steps, subroot, root)`` of every discovered item of ``items(uri, source, <fields>, <carried>)``.

    ``leaf`` is the digest of ``fields`` in their order. Per ``source`` the leaves ascend by ``uri`` (null first); while more than one
    node remains, every sixteen consecutive ones become the SHA-256 of their digests, and the last one is ``subroot``.
    The subroots ascend by source (null first, bytewise) and give ``root`` in the same way. ``steps ARRAY<STRUCT<before, after>>``
    holds, from the leaf up, the digests before and after the own one at each hashed level: see :func:`folded` and :func:`siblings`.

    Rows that share a ``uri`` are leaves of their own, in the order of their digests. Null fields are leaves' values like any others;
    carried columns travel along and bear on no digest; other columns are ignored; an empty table gives an empty table. A source with most
    of the items is many blocks; ranks are taken over ranges, so no task holds a source.
    """
    shelf = Shelf(items.sparkSession, "manifest")
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    leaves = items.select(tree.alias("tree"), item_digest(*[F.col(f) for f in fields]).alias("digest"), F.struct("uri", "source", *carried).alias("item"))
    leaves = shelf.keep(leaves, "leaves")
    order = [F.asc_nulls_first("item.uri"), F.col("digest"), F.xxhash64("item")]
    numbered = ordered_rank(leaves, ["tree"], order, "place").withColumn("rank", F.col("place") - 1)
    tiers = tiers_of(numbered.select("tree", "rank", "digest", "item"), shelf)

    subroots = tiers[-1].select(F.lit(FOREST).alias("tree"), "digest", F.col("tree").alias("item"))
    named = F.nullif(F.col("item"), F.lit("-"))  # null sorts first; the others share their first letter
    forest = ordered_rank(subroots, ["tree"], [F.asc_nulls_first(named)], "place").withColumn("rank", F.col("place") - 1)
    forest_tiers = tiers_of(forest.select("tree", "rank", "digest", "item"), shelf)
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    top = forest_tiers[-1].select("tree", no_steps.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = proven(forest_tiers, top).select(F.col("item").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    return proven(tiers, tops).select("item.*", F.col("digest").alias("leaf"), "steps", "subroot", "root")
