"""Frames whose ends are continued by the nearest value, and sliding counts of distinct items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_sum(x: Column, before: int, after: int, keys: list[str], order: str = "t") -> Column:
    """Sum over places t - before to t + after, the first and last value standing in beyond the ends.

    What a clipped frame lacks is added from the ends, so no padding rows are made.
    """
    part = Window.partitionBy(*keys)
    ordered = part.orderBy(order)
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(ordered) - 1
    rest = F.count(F.lit(1)).over(part) - 1 - place
    missing = lambda frame, have: F.greatest(F.lit(0), F.lit(frame) - have)
    inside = F.sum(x).over(ordered.rowsBetween(-before, after))
    return inside + missing(before, place) * F.first(x).over(full) + missing(after, rest) * F.last(x).over(full)


def nearest_mean(x: Column, before: int, after: int, keys: list[str], order: str = "t") -> Column:
    return nearest_sum(x, before, after, keys, order) / F.lit(before + after + 1)


def nearest_values(x: Column, radius: int, keys: list[str], order: str = "t") -> Column:
    """Array of the values at places t - radius to t + radius, continued at the ends."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(full), F.last(x).over(full)
    return F.array(*[F.coalesce(F.lag(x, -d).over(ordered), first if d < 0 else last) for d in range(-radius, radius + 1)])


def sliding_distinct(items: DataFrame, spine: DataFrame, radius: int, n: str = "n", distinct: str = "n_distinct") -> DataFrame:
    """For every (room, t) of spine: items (room, t, item) within the radius, and how many are different.

    Items may be counted before: then each (room, t, item) is there once, with its number in column c.

    The ticks near an item's occurrences form islands; each adds one from its first tick and takes it
    away after its last, so the numbers are running sums: nothing is exploded or collected by window.
    """
    last = Window.partitionBy("room", "item").orderBy("t")
    once = items.select("room", "item", "t", "c") if "c" in items.columns else items.groupBy("room", "item", "t").agg(F.count(F.lit(1)).alias("c"))
    gap = once.withColumn("from", F.lag("t").over(last)).withColumn("to", F.lead("t").over(last))
    opens = gap.where(F.col("from").isNull() | (F.col("t") - F.col("from") > 2 * radius + 1)).select("room", (F.col("t") - radius).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("c"))
    closes = gap.where(F.col("to").isNull() | (F.col("to") - F.col("t") > 2 * radius + 1)).select("room", (F.col("t") + radius + 1).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("c"))
    more = once.select("room", (F.col("t") - radius).alias("t"), F.lit(0).alias("d"), F.col("c"))
    less = once.select("room", (F.col("t") + radius + 1).alias("t"), F.lit(0).alias("d"), (-F.col("c")).alias("c"))
    steps = opens.unionByName(closes).unionByName(more).unionByName(less).groupBy("room", "t").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    asked = spine.select("room", "t", F.lit(1).alias("asked"))
    run = Window.partitionBy("room").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.join(steps, ["room", "t"], "full").select("room", "t", "asked", F.sum(F.coalesce("d", F.lit(0))).over(run).alias(distinct), F.sum(F.coalesce("c", F.lit(0))).over(run).alias(n))
    return both.where("asked = 1").drop("asked")
