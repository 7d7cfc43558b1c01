"""Whole plans: from signals to highlights."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.functions.settle import settle
from tidepeak.operators import detect, intervals, normalize, rerank


def from_curve(curve: DataFrame, k: float, settings: Scoring, top: int = 20) -> DataFrame:
    """Peaks of a curve, expanded, merged, cut and ranked: (room, start, end, score, rank)."""
    curve = settle(curve)  # peaks, expansion and cuts read it
    ranges = intervals.number(detect.peak_ranges(detect.hot_ticks(curve, k, settings), settings.gap))
    wide = intervals.expand(ranges, curve, settings.min_duration, settings.max_duration)
    merged = intervals.merge_near(wide, settings.merge_distance)
    cut = intervals.best_subwindow(merged, curve, settings.max_duration)
    return rerank.top_k(cut, top).select("room", "start", "end", "score", "rank")


def point_candidates(curve: DataFrame, z: DataFrame, settings: Scoring, k: float | None = None) -> DataFrame:
    """Merged peak ranges (room, id, start, end, score) of a stored curve, before the quality filter."""
    n = intervals.sizes(curve)
    ranges = intervals.number(detect.peak_ranges(detect.hot_ticks(curve, settings.sensitivity if k is None else k, settings), settings.gap))
    wide = intervals.expand(intervals.valley_bounds(ranges, z, n, settings), curve, settings.min_duration, settings.max_duration, n)
    return intervals.best_subwindow(intervals.merge_near(wide, settings.merge_distance), curve, settings.max_duration)


def point_clips(good: DataFrame, z: DataFrame, settings: Scoring) -> DataFrame:
    named = intervals.with_trigger(good, z, settings.trigger_z)
    return named.select(
        "room", "id", F.bround("start", 1).alias("start"), F.bround("end", 1).alias("end"), F.bround("score", 3).alias("score"), F.col("p"), "trigger",
        intervals.title(F.col("trigger"), F.col("start")).alias("title"), intervals.tags(F.col("trigger")).alias("tags"), (F.col("start") + 3).alias("thumbnail"),
    )


def point_curve(signals: DataFrame, weights: DataFrame | str, settings: Scoring) -> tuple[DataFrame, DataFrame]:
    """z and curve, each stored once, as later steps read them several times."""
    z = settle(normalize.compensate_lag(normalize.preprocess(signals, settings)))
    weights = normalize.profile_weights(signals, weights) if isinstance(weights, str) else weights
    return z, settle(normalize.decayed_curve(z, weights, settings))


def point_scores(signals: DataFrame, profile: str | DataFrame = "default", k: float | None = None, settings: Scoring = Scoring()) -> DataFrame:
    """The point scorer: clips (room, id, start, end, score, p, trigger, title, tags) of aligned signals; profile is a name or weights (room, signal, w)."""
    z, curve = point_curve(signals, profile, settings)
    return point_clips(intervals.quality(point_candidates(curve, z, settings, k), curve, settings), z, settings)


class PointTables(NamedTuple):
    """clips; dropped (room, start, end, score, source, reason); adjustments (room, start, end, from_start, from_end, reason, p)."""

    clips: DataFrame
    dropped: DataFrame
    adjustments: DataFrame


def point_tables(signals: DataFrame, profile: str | DataFrame = "default", k: float | None = None, settings: Scoring = Scoring()) -> PointTables:
    """point_scores() with what it dropped (duplicate, too_short) and changed (trimmed_too_long, insufficient_context, t_test_insignificant)."""
    z, curve = point_curve(signals, profile, settings)
    n = intervals.sizes(curve)
    ranges = intervals.number(detect.peak_ranges(detect.hot_ticks(curve, settings.sensitivity if k is None else k, settings), settings.gap))
    wide = settle(intervals.expand(intervals.valley_bounds(ranges, z, n, settings), curve, settings.min_duration, settings.max_duration, n))
    judged = settle(intervals.judged(intervals.best_subwindow(intervals.merge_near(wide, settings.merge_distance), curve, settings.max_duration), curve, settings, n))
    lost = F.array_contains("reasons", "too_short")
    clips = point_clips(judged.where(~lost).select("room", "id", "start", "end", "score", "p"), z, settings)
    same = intervals.merged_away(wide, settings.merge_distance).select("room", "start", "end", "score", F.lit("peak").alias("source"), "reason")
    empty = F.col("from_end") <= F.col("from_start")
    short = judged.where(lost).select("room", F.when(empty, F.col("from_start")).otherwise(F.col("start")).alias("start"), F.when(empty, F.col("from_end")).otherwise(F.col("end")).alias("end"), F.bround("score", 3).alias("score"), F.lit("peak").alias("source"), F.lit("too_short").alias("reason"))
    each = judged.select("*", F.explode("reasons").alias("reason")).where("reason <> 'too_short'")
    trimmed = F.col("reason") == "trimmed_too_long"
    adjustments = each.select(
        "room", F.bround("start", 1).alias("start"), F.bround("end", 1).alias("end"), F.when(trimmed, F.col("from_start")).alias("from_start"), F.when(trimmed, F.col("from_end")).alias("from_end"),
        "reason", F.when(F.col("reason") == "t_test_insignificant", F.bround("p", 4)).alias("p"),
    )
    return PointTables(clips, same.unionByName(short), adjustments)


def two_stage_tables(signals: DataFrame, asr: DataFrame | None = None, profile: str = "default", low: float = 15.0, high: float = 90.0, platform: str = "none", settings: TwoStage = TwoStage()) -> tuple[DataFrame, rerank.Reranked]:
    """Candidates of the first stage and all tables of the second. z and curves are computed once and kept."""
    z = settle(normalize.robust_z(signals))
    weights = normalize.profile_weights(signals, profile)
    recall = settle(detect.recall(settle(normalize.recall_curve(z, weights, settings.onset)), z, weights, low, high, settings))
    return recall, rerank.reranked(recall, z, weights, settle(normalize.base_score(z, weights)), asr, profile, low, high, platform, settings=settings)


def two_stage(signals: DataFrame, asr: DataFrame | None = None, profile: str = "default", low: float = 15.0, high: float = 90.0, platform: str = "none", settings: TwoStage = TwoStage()) -> DataFrame:
    """The two-stage scorer: candidates by recall, then clips by rerank."""
    return two_stage_tables(signals, asr, profile, low, high, platform, settings)[1].clips.drop("boundary_reasons", "reasons")
