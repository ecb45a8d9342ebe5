"""Running sums over a global order, without one task per group.

A window over one hot group would sort that group in a single task. Here the rows are range
partitioned over the whole order (so a hot group is cut into many ranges), summed per range, and
each range gets the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut_lineage


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str],
                 totals: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add, per ``keys`` group and in ``order``, the inclusive running total of each summed column.

    ``order`` must be a total order inside a group. ``sums`` maps new column to summed (integer)
    column; ``totals`` maps further new columns to running columns whose group total they hold.
    The ranges are checkpointed because both passes must see the same boundaries. The local window
    is partitioned by range and group, so no window partition exceeds one range.
    """
    size = [partitions] if partitions else []  # left open, AQE merges neighbouring small ranges
    ranged = cut_lineage(df.repartitionByRange(*size, *[F.col(k) for k in keys], *order)
                         .withColumn("__range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = (ranged.groupBy(*keys, "__range")
                 .agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()]))
    offsets = per_range.select(
        *keys, "__range",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).cast("bigint").alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{source}").over(group).cast("bigint").alias(n) for n, source in (totals or {}).items()])

    local = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({n: F.sum(c).over(local) for n, c in sums.items()})
    out = inside.join(offsets, [*keys, "__range"])
    out = out.withColumns({n: (F.col(n) + F.col(f"__o_{n}")).cast("bigint") for n in sums})
    return out.drop("__range", *[f"__o_{n}" for n in sums])


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in ``order``; hot groups are cut into ranges."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sums(ones, keys, order, {name: "__one"}).drop("__one")


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                  name: str) -> DataFrame:
    """Number rows per group in two steps, for an order that comes with a natural bucket.

    ``bucket`` must rise with ``order`` (an hour of a timestamp, a block of a frame number). A hot
    group is ranked bucket by bucket; only one count per bucket is ordered group-wide.
    """
    work = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (work.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
               .select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (work.withColumn(name, F.row_number().over(inside))
            .join(offsets, [*keys, "__bucket"])
            .withColumn(name, (F.col(name) + F.col("__offset")).cast("bigint"))
            .drop("__bucket", "__offset"))


def running_balance(df: DataFrame, keys: Sequence[str], order: Sequence[Column], gain: str, loss: str) -> DataFrame:
    """Add, per ``keys`` group and in ``order``, what a queue of gains looks like to the losses that draw on it.

    ``gain`` and ``loss`` are whole numbers per row. Adds the running ``gains`` and ``losses`` (both inclusive), and ``missed``: how many
    losses before this row found nothing left. A range is folded to three numbers (gains, losses, greatest excess of losses), which
    combine associatively, so a hot group is cut into ranges as for sums. ``order`` must be total inside a group.
    """
    ranged = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "__range").orderBy(*order)
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({"gains": F.sum(gain).over(upto), "losses": F.sum(loss).over(upto)})
    inside = inside.withColumn("__peak", F.max(F.col("losses") - F.col("gains")).over(before))
    per_range = inside.groupBy(*keys, "__range").agg(F.sum(gain).alias("g"), F.sum(loss).alias("l"), F.max(F.col("losses") - F.col("gains")).alias("p"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumns({"__g": F.coalesce(F.sum("g").over(earlier), F.lit(0)), "__l": F.coalesce(F.sum("l").over(earlier), F.lit(0))})
    starts = starts.withColumn("__p", F.max(F.col("p") + F.col("__l") - F.col("__g")).over(earlier)).select(*keys, "__range", "__g", "__l", "__p")
    out = inside.join(starts, [*keys, "__range"])
    missed = F.greatest(F.lit(0), F.col("__p"), F.col("__peak") + F.col("__l") - F.col("__g"))
    return out.withColumns({"gains": (F.col("gains") + F.col("__g")).cast("bigint"), "losses": (F.col("losses") + F.col("__l")).cast("bigint"),
                            "missed": missed.cast("bigint")}).drop("__range", "__peak", "__g", "__l", "__p")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], name: str) -> DataFrame:
    """Add the struct ``name`` of the row before each row of its group; ranges hand on one row each."""
    ranged = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "__range").orderBy(*order)
    inside = ranged.withColumns({name: F.lag(F.struct(*columns)).over(local), "__back": F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*[c.desc() for c in order]))})
    last = inside.where("__back = 1").select(*keys, "__range", F.struct(*columns).alias("__last"))
    carried = last.select(*keys, "__range", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range")).alias("__carried"))
    return inside.join(carried, [*keys, "__range"]).withColumn(name, F.coalesce(name, "__carried")).drop("__range", "__back", "__carried")
