"""Operators on measurements that were taken from sound and pictures before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_change(frames: DataFrame) -> DataFrame:
    """(room, frame, value): length of the change of each frame's vector; 0 for the first."""
    w = Window.partitionBy("room").orderBy("frame")
    square = F.aggregate(F.zip_with("vec", F.lag("vec").over(w), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return frames.select("room", "frame", F.coalesce(F.sqrt(square), F.lit(0.0)).alias("value"))


def loud_ticks(series: DataFrame, factor: float = 2.0) -> DataFrame:
    """Ticks whose value is over the room's mean by `factor` deviations."""
    part = Window.partitionBy("room")
    return series.withColumn("limit", F.avg("value").over(part) + factor * F.stddev_pop("value").over(part)).where("value > limit").drop("limit")


def spaced(times: DataFrame, gap: float) -> DataFrame:
    """Times (room, t) of which each is at least `gap` after the last one kept. Sequential; one array of times a room."""
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.col("t").cast("double"))), F.array().cast("array<double>"),
        lambda held, t: F.when((F.size(held) == 0) | (t - F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(float("-inf"))) >= gap), F.concat(held, F.array(t))).otherwise(held),
    )
    return times.groupBy("room").agg(kept.alias("kept")).select("room", F.explode("kept").alias("t"))


def scene_score(hue: Column, hue_before: Column, sat: Column, sat_before: Column, val: Column, val_before: Column) -> Column:
    """Mean of the changes of hue (a circle of 180), saturation and value over histograms of one length."""
    mean = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    turn = F.zip_with(hue, hue_before, lambda a, b: F.least(F.abs(a - b), 180 - F.abs(a - b)))
    plain = lambda x, y: F.zip_with(x, y, lambda a, b: F.abs(a - b))
    return (mean(turn) + mean(plain(sat, sat_before)) + mean(plain(val, val_before))) / 3


def scene_cuts(scores: DataFrame, limit: float = 27.0, gap: float = 1.0) -> DataFrame:
    """Times of (room, t, value) with at least the limit, `gap` seconds apart."""
    return spaced(scores.where(F.col("value") >= limit).select("room", "t"), gap)


def visual_mode(asked: Column, proxy_ok: Column) -> Column:
    """(mode, reason): which way of reading pictures is taken."""
    return F.when((asked == "proxy") & proxy_ok, F.struct(F.lit("proxy").alias("mode"), F.lit("").alias("reason"))).when(asked == "proxy", F.struct(F.lit("legacy").alias("mode"), F.lit("proxy_failed").alias("reason"))).otherwise(F.struct(F.lit("legacy").alias("mode"), F.lit("").alias("reason")))


def frame_rate(rate: Column) -> Column:
    """A rate such as 30000/1001 as a number; 0 if it has no denominator."""
    parts = F.split(rate, "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, F.coalesce(number(0), F.lit(0.0))).otherwise(F.coalesce(F.try_divide(number(0), number(1)), F.lit(0.0)))
