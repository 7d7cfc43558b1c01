"""Second stage: window features, refits, boundary search, scores, suppression, top-k."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.config import BOOSTS, DURATIONS, EDGE_WEIGHTS, PLATFORMS, TwoStage
from tidepeak.functions.settle import settle
from tidepeak.operators.detect import local_maxima
from tidepeak.operators.intervals import ticks
from tidepeak.operators.normalize import squash
from tidepeak.schema import room_type

#: Titles by the first name that a trigger contains, and tags by all names, in order.
TITLES = (
    ("asrKeyword", "💬 关键词片段"), ("keywordShopping", "🛒 带货爆点"), ("keywordFunny", "😂 搞笑高能"), ("keywordHighEnergy", "🔥 高能时刻"), ("keywordInteractive", "💬 互动高光"),
    ("keywordEmotional", "💗 情感时刻"), ("keywordControversy", "⚡ 争议片段"), ("eventLaughter", "😂 搞笑高能"), ("eventApplause", "👏 精彩时刻"), ("dmDensity", "🔥 弹幕爆发"),
    ("dmAcceleration", "🔥 弹幕爆发"), ("speakerChange", "🗣 连麦高光"), ("rms", "🔊 音量爆发"), ("motion", "📹 画面高能"), ("sceneChange", "🎬 场景切换"),
)
TAGS = (
    ("asrKeyword", "关键词"), ("keywordHighEnergy", "高能"), ("keywordFunny", "搞笑"), ("keywordControversy", "争议"), ("keywordInteractive", "互动"), ("keywordEmotional", "情感"), ("keywordShopping", "带货"),
    ("eventLaughter", "搞笑"), ("eventApplause", "精彩"), ("dmDensity", "互动"), ("dmAcceleration", "爆发"), ("dmUniqueUsers", "互动"), ("speakerChange", "连麦"), ("topicChange", "话题"), ("rms", "音量"), ("motion", "动作"), ("sceneChange", "场景"),
)
ID = ["room", "id"]


def duration_fit(d: Column, low: Column, high: Column) -> Column:
    """1 inside the range, less the farther outside, 0 for nothing."""
    return F.when(d <= 0, 0.0).when(d < low, d / low).when(d > high, high / d).otherwise(1.0)


def window_signals(windows: DataFrame, z: DataFrame, weights: DataFrame, agreement: float = 1.0) -> DataFrame:
    """Per (room, id, signal): weight, peak, mean, area, differences to the equally long neighbours, activity, contribution.

    Windows (room, id, start, end) meet z by ticks from a length before to a length after, aggregated with conditions.
    """
    rows = windows.select("room", "id", F.bround("start").cast("int").alias("s"), F.bround("end").cast("int").alias("e")).withColumn("len", F.col("e") - F.col("s"))
    spread = ticks(rows, F.greatest(F.lit(0), F.col("s") - F.col("len")), F.col("e") + F.col("len") - 1)
    inside, before = (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")), F.col("t") < F.col("s")
    value = F.col("value")
    stats = spread.join(z.select("room", "t", "signal", "ord", "value"), ["room", "t"]).groupBy("room", "id", "s", "e", "signal", "ord").agg(
        F.max(F.when(inside, value)).alias("peak"),
        F.avg(F.when(inside, value)).alias("mean"),
        F.sum(F.when(inside, F.greatest(value, F.lit(0.0)))).alias("area"),
        F.avg(F.when(before, value)).alias("pre"),
        F.avg(F.when(~before & ~inside, value)).alias("post"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    full = stats.join(weights, ["room", "signal"], "left").withColumns({c: zero(c) for c in ("peak", "mean", "area", "pre", "post", "w")})
    mean = F.col("mean")
    active = (F.col("w") > 0) & ((F.col("peak") >= agreement) | ((mean >= agreement * 0.5) & (F.col("peak") > 0.1)))
    return full.select(
        "room", "id", "signal", "ord", F.col("w").alias("weight"), "peak", "mean", "area", (mean - F.col("pre")).alias("pre_delta"), (mean - F.col("post")).alias("post_delta"),
        active.alias("active"), (F.col("w") * mean).alias("contribution"), "s", "e",
    )


def window_totals(signals: DataFrame) -> DataFrame:
    """Per (room, id): weighted peak, mean, area, difference to the neighbours, agreement, novelty, active signals."""
    w = F.col("weight")
    length = F.col("e") - F.col("s")
    active = F.filter(F.array_sort(F.collect_list(F.when(F.col("active"), F.struct((-F.round("contribution", 6)).alias("by"), "signal")))), lambda x: x.isNotNull())
    out = signals.groupBy("room", "id", "s", "e").agg(
        F.sum(w * F.col("peak")).alias("peak_score"),
        F.sum(w * F.col("mean")).alias("mean_score"),
        F.coalesce(F.sum(w * F.try_divide(F.col("area"), length)), F.lit(0.0)).alias("area_score"),
        F.sum(w * (F.col("pre_delta") + F.col("post_delta")) / 2).alias("pre_post_delta"),
        F.sum(F.when(F.col("active"), w).otherwise(0.0)).alias("agreement"),
        F.sqrt(F.avg(F.when(w > 0, F.pow("pre_delta", F.lit(2))))).alias("novelty"),
        F.transform(active, lambda x: x["signal"]).alias("active_signals"),
    )
    return out.withColumn("novelty", F.when(F.col("s") > 0, F.coalesce("novelty", F.lit(0.0))).otherwise(0.0))


def window_breakdown(signals: DataFrame, top: int = 8) -> DataFrame:
    """(room, id, signal, contribution, rank): the largest contributions of weighted signals to each window, equal ones by name."""
    part = signals.where("weight > 0").select("room", "id", "signal", F.round("contribution", 6).alias("contribution"))
    rank = F.row_number().over(Window.partitionBy("room", "id").orderBy(F.desc(F.abs("contribution")), "signal"))
    return part.withColumn("rank", rank).where(F.col("rank") <= top)


def content_type(profile: Column, signals: Column) -> Column:
    has = lambda s: F.array_contains(signals, s)
    return F.when(profile.isin("shopping", "talent", "game"), profile).when(has("speakerChange"), "interaction").when(has("eventLaughter"), "funny").when(has("eventMusic"), "talent").otherwise("default")


def duration_range(kind: Column, low: float, high: float, platform: str = "none") -> tuple[Column, Column]:
    """Target range of a content type within the given bounds, narrowed to the platform's if that leaves any."""
    pick = lambda i: F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in DURATIONS.items()], F.lit(DURATIONS["default"][i]))
    lo, hi = F.greatest(F.lit(float(low)), pick(0)), F.least(F.lit(float(high)), pick(1))
    empty = lo > hi
    if platform in PLATFORMS:
        a, b = F.greatest(lo, F.lit(PLATFORMS[platform][0])), F.least(hi, F.lit(PLATFORMS[platform][1]))
        lo, hi = F.when(a <= b, a).otherwise(lo), F.when(a <= b, b).otherwise(hi)
    return F.when(empty, float(low)).otherwise(lo), F.when(empty, float(high)).otherwise(hi)


def prefix_sums(curve: DataFrame) -> DataFrame:
    """(room, t, upto): sum of scores before t, for t from 0 to the end."""
    w = Window.partitionBy("room").orderBy("t")
    upto = F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, 0))
    sums = curve.select("room", F.row_number().over(w).alias("place"), F.struct((F.col("t") + 1).alias("t"), upto.alias("upto")).alias("s"))
    # the first row brings the empty sum too
    none = F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("upto"))
    return sums.select("room", F.inline(F.when(F.col("place") == 1, F.array(none, "s")).otherwise(F.array("s"))))


def select_window(windows: DataFrame, curve: DataFrame, radius: int = 8) -> DataFrame:
    """Windows (room, id, start, end, low, high, ...) fitted to [low, high] and moved by up to `radius` to the highest sum.

    Of equal sums the place closest to the original wins, then the earlier. Adds `changed`.
    """
    n = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    rows = windows.join(n, "room").withColumn("dur", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    size = F.greatest(F.lit(1), F.least(F.col("n").cast("int"), F.bround(F.least(F.greatest("dur", "low"), F.col("high"))).cast("int")))
    rows = rows.withColumn("size", size).withColumn("most", F.greatest(F.lit(0), F.col("n").cast("int") - F.col("size")))
    rows = rows.withColumn("base", F.least(F.greatest(F.lit(0), F.bround("start").cast("int")), F.col("most")))
    placed = ticks(rows.select("room", "id", "base", "size", "most"), F.greatest(F.lit(0), F.col("base") - radius), F.least("most", F.col("base") + radius), "at")
    p = prefix_sums(curve)
    left = p.select("room", F.col("t").alias("at"), F.col("upto").alias("p0"))
    right = p.select("room", F.col("t").alias("till"), F.col("upto").alias("p1"))
    scored = placed.withColumn("till", F.col("at") + F.col("size")).join(left, ["room", "at"]).join(right, ["room", "till"])
    rank = F.struct(F.round(F.col("p1") - F.col("p0"), 9), -F.abs(F.col("at") - F.col("base")), -F.col("at"))
    best = scored.groupBy("room", "id").agg(F.max_by("at", rank).alias("at"))
    out = rows.join(best, ID)
    whole = F.col("n") <= F.col("low")
    start, end = F.when(whole, 0.0).otherwise(F.col("at").cast("double")), F.when(whole, F.col("n").cast("double")).otherwise((F.col("at") + F.col("size")).cast("double"))
    changed = F.when(whole, (F.abs("start") > 0.05) | (F.abs(F.col("end") - F.col("n")) > 0.05)).otherwise((F.col("size") != F.bround("dur").cast("int")) | (F.abs(F.col("at") - F.col("start")) > 0.05))
    kept = [c for c in windows.columns if c not in ("start", "end")]
    return out.select(*kept, start.alias("start"), end.alias("end"), changed.alias("changed"))


def extrema(series: DataFrame, lowest: bool) -> DataFrame:
    """(room, t, value): local maxima, or minima, of (room, t, score)."""
    sign = -1.0 if lowest else 1.0
    return local_maxima(series.select("room", "t", (F.col("score") * sign).alias("score"))).select("room", "t", (F.col("score") * sign).alias("value"))


def edge_candidates(edges: DataFrame, z: DataFrame, curve: DataFrame, asr: DataFrame | None, search: float = 8.0, limit: int = 10) -> DataFrame:
    """Edges (room, id, edge) with up to `limit` places (time, source, weight, cost, rank) to move to within `search`.

    Places are sentence ends, quiet ticks, scene cuts, score valleys and the edge itself; of one time, the most trusted stays.
    """
    n = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    rows = edges.join(n, "room").withColumn("lo", F.greatest(F.lit(0), F.floor(F.col("edge") - search)).cast("int")).withColumn("hi", F.least("n", F.ceil(F.col("edge") + search)).cast("int"))
    around = ticks(rows, F.col("lo"), F.col("hi"))
    last = F.greatest(F.col("lo"), F.least(F.col("n") - 1, F.col("hi")))
    signal = lambda name: z.where(F.col("signal") == name).select("room", "t", F.col("value").alias("score"))
    inner = (F.col("t") > F.col("lo")) & (F.col("t") < last)

    def near(places: DataFrame, source: str) -> DataFrame:
        return around.join(places.select("room", "t").distinct(), ["room", "t"]).where(inner).select("room", "id", "edge", F.col("t").cast("double").alias("time"), F.lit(source).alias("source"))

    found = rows.select("room", "id", "edge", F.bround("edge").alias("time"), F.lit("original").alias("source"))
    found = found.unionByName(near(extrema(signal("rms"), True), "silence"))
    found = found.unionByName(near(extrema(signal("sceneChange"), False).where("value >= 0.5"), "sceneChange"))
    found = found.unionByName(near(extrema(curve, True), "scoreValley"))
    if asr is not None:
        marks = asr.select("room", F.explode(F.array("start", "end")).alias("mark")).where("mark IS NOT NULL")
        ends = marks.withColumn("t", F.explode(F.array(F.floor("mark"), F.ceil("mark"))).cast("int")).distinct()
        spoken = around.join(ends, ["room", "t"]).where("mark BETWEEN lo AND hi").select("room", "id", "edge", F.bround("mark").alias("time"), F.lit("asrSentence").alias("source"))
        found = found.unionByName(spoken.distinct())
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in EDGE_WEIGHTS.items()])
    # dealt explicitly: Spark 4.1 takes the union of sides that are dealt by room as dealt by room (spark.sql.unionOutputPartitioning),
    # and in the plan of search_edges() an edge was then ranked in several parts
    found = found.repartition("room", "id")
    one = Window.partitionBy("room", "id", "time").orderBy(F.desc("weight"), "source")
    best = found.withColumn("weight", weight).withColumn("place", F.row_number().over(one)).where("place = 1")
    cost = F.abs(F.col("time") - F.col("edge")) / max(search, 1.0) - F.col("weight")
    order = Window.partitionBy("room", "id").orderBy("cost", "time")
    ranked = best.withColumn("cost", F.round(cost, 9)).withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= limit)
    # the edge itself is added beside the first place where no kept one is close to it
    near_edge = F.max(F.abs(F.col("time") - F.col("edge")) < 0.5).over(Window.partitionBy("room", "id"))
    own = F.struct(
        F.bround("edge").alias("time"), F.lit("original").alias("source"), F.lit(EDGE_WEIGHTS["original"]).alias("weight"),
        F.round(F.abs(F.bround("edge") - F.col("edge")) / max(search, 1.0) - EDGE_WEIGHTS["original"], 9).alias("cost"), F.lit(limit + 1).alias("rank"),
    )
    place = F.struct("time", "source", "weight", "cost", "rank")
    places = F.when((F.col("rank") == 1) & ~F.col("home"), F.array(place, own)).otherwise(F.array(place))
    return kept.withColumn("home", near_edge).select("room", "id", "edge", F.inline(places))


def search_edges(windows: DataFrame, z: DataFrame, curve: DataFrame, asr: DataFrame | None, search: float = 8.0, limit: int = 10) -> DataFrame:
    """Windows (room, id, start, end, low, high) with the start and end of the least joint cost, and their sources.

    The cost is that of both edges, of a duration outside [low, high], and of score lost. Each window has at most limit + 1 squared pairs.
    """
    side = lambda c: edge_candidates(windows.select("room", "id", F.col(c).alias("edge")), z, curve, asr, search, limit)
    left = side("start").select("room", "id", F.col("time").alias("a"), F.col("source").alias("start_source"), F.col("cost").alias("ca"), F.col("rank").alias("ra"))
    right = side("end").select("room", "id", F.col("time").alias("b"), F.col("source").alias("end_source"), F.col("cost").alias("cb"), F.col("rank").alias("rb"))
    p = prefix_sums(curve)
    at = lambda key, to: p.select("room", F.col("t").alias(key), F.col("upto").alias(to))
    based = windows.withColumn("s", F.col("start").cast("int")).withColumn("e", F.col("end").cast("int")).join(at("s", "p0"), ["room", "s"]).join(at("e", "p1"), ["room", "e"])
    pairs = left.join(right, ID).where("b - a >= 1").withColumn("ia", F.col("a").cast("int")).withColumn("ib", F.col("b").cast("int"))
    pairs = pairs.join(at("ia", "q0"), ["room", "ia"]).join(at("ib", "q1"), ["room", "ib"]).join(based.select("room", "id", "low", "high", (F.col("p1") - F.col("p0")).alias("base")), ID)
    d = F.col("b") - F.col("a")
    least, most = F.greatest("low", F.lit(1.0)), F.greatest("high", F.lit(1.0))
    misfit = F.when(d < F.col("low"), 1 + 2 * (F.col("low") - d) / least).when(d > F.col("high"), 1 + 2 * (d - F.col("high")) / most).otherwise(0.0)
    lost = F.greatest(F.lit(0.0), F.col("base") - (F.col("q1") - F.col("q0"))) / F.greatest(F.abs("base"), F.lit(1.0)) * 0.3
    order = Window.partitionBy("room", "id").orderBy("total", "ra", "rb")
    best = pairs.withColumn("total", F.round(F.col("ca") + F.col("cb") + misfit + lost, 8)).withColumn("place", F.row_number().over(order)).where("place = 1")
    out = windows.join(best.select("room", "id", "a", "b", "start_source", "end_source"), ID, "left")
    new_start, new_end = F.coalesce("a", "start"), F.coalesce("b", "end")
    source = lambda c: F.coalesce(c, F.lit("original"))
    kept = [c for c in windows.columns if c not in ("start", "end")]
    return out.select(
        *kept, new_start.alias("start"), new_end.alias("end"), source("start_source").alias("start_source"), source("end_source").alias("end_source"),
        ((F.abs(new_start - F.col("start")) >= 0.5) | (F.abs(new_end - F.col("end")) >= 0.5)).alias("moved"),
    )


def window_score(totals: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds score and confidence to totals (with low, high): squashed features, fit of the duration, bonuses up to 0.45."""
    boost = F.coalesce(*[F.when(F.col("signal") == s, F.lit(b)) for s, b in BOOSTS.items()], F.lit(0.0))
    bonus = signals.where("weight > 0 AND peak >= 1.0").groupBy("room", "id").agg(F.least(F.lit(0.45), F.sum(boost)).alias("bonus"))
    fit = duration_fit((F.col("e") - F.col("s")).cast("double"), F.col("low"), F.col("high"))
    base = 0.28 * squash(F.col("peak_score"), 2.0) + 0.22 * squash(F.col("mean_score"), 1.5) + 0.18 * squash(F.col("pre_post_delta"), 1.0) + 0.14 * F.col("agreement") + 0.08 * squash(F.col("novelty"), 2.0) + 0.10 * F.col("fit")
    rows = totals.withColumn("fit", fit).join(bonus, ID, "left").withColumn("base", base)
    score = F.col("base") + F.coalesce("bonus", F.lit(0.0))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * F.col("base") + 0.4 * score))
    return rows.withColumn("score", F.round(score, 4)).withColumn("confidence", F.round(confidence, 4)).drop("bonus", "base")


def risks(adjusted: Column, has_asr: Column) -> Column:
    """Names of the thresholds that a scored window misses, in order."""
    checks = (
        (F.col("agreement") < 0.3, "low_signal_agreement"), (F.col("novelty") < 0.1, "low_novelty"), (F.col("fit") < 0.9, "duration_mismatch"),
        (adjusted, "window_adjusted"), (~has_asr, "asr_missing"), (F.size("active_signals") == 0, "no_active_signal"),
    )
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def title(trigger: Column, start: Column) -> Column:
    name = F.lit("📹 高光时刻")
    for key, text in reversed(TITLES):
        name = F.when(trigger.contains(key), F.lit(text)).otherwise(name)
    return F.concat(name, F.lit(" ("), start.cast("int").cast("string"), F.lit("s)"))


def tags(trigger: Column) -> Column:
    found = F.array_distinct(F.filter(F.array(*[F.when(trigger.contains(k), F.lit(v)) for k, v in TAGS]), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("高光")))


def suppress_overlaps(clips: DataFrame, ratio: float = 0.6) -> DataFrame:
    """(room, id, kept, kept_start, kept_end): by falling score, a clip goes if it overlaps a kept one by `ratio` of the shorter.

    Sequential within a room, whose clips the candidate budget keeps few.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, kept = [], []
        for r in rows.sort_values(["score", "start", "id"], ascending=[False, True, True]).itertuples():
            by = next((k for k in kept if (s := min(r.end - r.start, k.end - k.start)) > 0 and (min(r.end, k.end) - max(r.start, k.start)) / s >= ratio), None)
            if by is None:
                kept.append(r)
            out.append((r.room, r.id, by is None, None if by is None else by.start, None if by is None else by.end))
        return pd.DataFrame(out, columns=["room", "id", "kept", "kept_start", "kept_end"])

    return clips.select("room", "id", "start", "end", "score").groupBy("room").applyInPandas(run, f"room {room_type(clips)}, id int, kept boolean, kept_start double, kept_end double")


def top_k(clips: DataFrame, k: int = 20) -> DataFrame:
    """Adds rank by (score descending, start); the first k of a room stay."""
    return clips.withColumn("rank", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("score"), "start", "id"))).where(F.col("rank") <= k)


def beyond_top_k(clips: DataFrame, k: int = 20) -> DataFrame:
    """What top_k() leaves out, with its rank and the reason."""
    rank = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("score"), "start", "id"))
    return clips.withColumn("rank", rank).where(F.col("rank") > k).withColumn("reason", F.lit("top_k_cut"))


class Reranked(NamedTuple):
    """clips; dropped (room, start, end, score, source, reason, kept_start, kept_end); adjustments (room, start, end, from_start, from_end, reason, start_source, end_source)."""

    clips: DataFrame
    dropped: DataFrame
    adjustments: DataFrame


def reranked(
    candidates: DataFrame, z: DataFrame, weights: DataFrame, curve: DataFrame, asr: DataFrame | None = None, profile: str | Column = "default", low: float = 15.0, high: float = 90.0,
    platform: str = "none", search: float = 8.0, settings: TwoStage = TwoStage(),
) -> Reranked:
    """The second stage: candidates typed, fitted, moved to good edges, scored, suppressed and cut to the top k of a room.

    Reasons of what is dropped: too_short, below_min_score, overlap, top_k_cut; of adjustments: stage2_duration_fit, boundary_optimized.
    """
    who = profile if isinstance(profile, Column) else F.lit(profile)
    kind = content_type(who, F.col("sources"))
    lo, hi = duration_range(kind, low, high, platform)
    # each step reads the one before several times, and candidates are few: they are kept
    placed_at = [F.col("start").alias("from_start"), F.col("end").alias("from_end")]
    first = candidates.select("room", "id", "start", "end", "sources", F.col("score").alias("recall_score"), kind.alias("kind"), lo.alias("low"), hi.alias("high"), *placed_at)
    every = settle(select_window(settle(first), curve, settings.radius))
    fitted = every.where("end - start >= 1")
    active = window_totals(window_signals(fitted, z, weights, settings.agreement_z)).select("room", "id", "active_signals")
    typed = fitted.join(active, ID).withColumn("kind", content_type(who, F.concat("sources", "active_signals")))
    lo, hi = duration_range(F.col("kind"), low, high, platform)
    typed = settle(typed.withColumns({"low": lo, "high": hi}).drop("active_signals").withColumnRenamed("changed", "refit"))
    refitted = settle(select_window(typed, curve, settings.radius).withColumns({"edge_start": F.col("start"), "edge_end": F.col("end")}))
    original = {"start_source": F.lit("original"), "end_source": F.lit("original")}
    moved = search_edges(refitted, z, curve, asr, search, settings.edge_limit) if search > 0 else refitted.withColumns(original | {"moved": F.lit(False)})
    moved = settle(moved)
    # an edge search that leaves the range by over half a second is fitted again, and no longer counts as a move to edges
    fits = ~F.col("moved") | (F.col("end") - F.col("start")).between(F.col("low") - 0.5, F.col("high") + 0.5)
    fit = moved.where(fits).withColumn("fallback", F.lit(False))
    again = select_window(moved.where(~fits).withColumnRenamed("changed", "before").drop("start_source", "end_source"), curve, settings.radius)
    shifted = (F.abs(F.col("start") - F.col("edge_start")) >= 0.5) | (F.abs(F.col("end") - F.col("edge_end")) >= 0.5)
    again = again.withColumn("fallback", shifted).withColumns(original | {"moved": F.lit(False), "changed": F.col("before") | F.col("fallback")})
    again = again.withColumns({"start": F.when(F.col("fallback"), F.col("start")).otherwise(F.col("edge_start")), "end": F.when(F.col("fallback"), F.col("end")).otherwise(F.col("edge_end"))})
    placed = settle(fit.unionByName(again.select(fit.columns)))
    signals = settle(window_signals(placed, z, weights, settings.agreement_z))
    scored = window_score(window_totals(signals).join(placed.drop("start", "end"), ID), signals)
    spoken = z.where("signal = 'asrKeyword' AND value <> 0").select("room").distinct().withColumn("spoken", F.lit(True))
    named = scored.join(spoken, "room", "left").withColumn("all_sources", F.array_distinct(F.concat("sources", "active_signals")))
    trigger = F.when(F.size("all_sources") > 0, F.array_join(F.slice("all_sources", 1, 5), "+")).otherwise("unknown")
    edges = F.array_distinct(F.transform(F.filter(F.array("start_source", "end_source"), lambda x: x != "original"), lambda x: F.concat(F.lit("boundary_"), x)))
    refit = F.col("changed") | F.col("refit")
    warned = risks(refit | F.col("moved"), F.coalesce("spoken", F.lit(False)))
    clips = settle(named.select(
        "room", F.col("id").cast("int").alias("id"), F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"), "score", "confidence", F.col("kind").alias("content_type"),
        "start_source", "end_source", trigger.alias("trigger"), F.when(F.col("fallback"), F.concat(warned, F.array(F.lit("boundary_fallback")))).otherwise(warned).alias("risks"), "recall_score",
        edges.alias("boundary_reasons"), F.array_distinct(F.concat("all_sources", edges)).alias("reasons"), refit.alias("refitted"), "moved", "from_start", "from_end", "edge_start", "edge_end",
    ))
    good = clips.where(F.col("score") >= settings.min_score)
    judged = settle(suppress_overlaps(good, settings.overlap))
    ranked = settle(good.join(judged.where("kept").select("room", "id"), ID).withColumn("rank", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("score"), "start", "id"))))
    gone = lambda rows, reason, a="start", b="end", score="score", ka=None, kb=None: rows.select(
        "room", F.col(a).alias("start"), F.col(b).alias("end"), F.col(score).alias("score"), F.lit("two_stage").alias("source"), F.lit(reason).alias("reason"),
        (F.col(ka) if ka else F.lit(None).cast("double")).alias("kept_start"), (F.col(kb) if kb else F.lit(None).cast("double")).alias("kept_end"),
    )
    short = every.where("end - start < 1").withColumns({"from_start": F.bround("from_start", 2), "from_end": F.bround("from_end", 2)})
    dropped = gone(short, "too_short", "from_start", "from_end", "recall_score").unionByName(gone(clips.where(F.col("score") < settings.min_score), "below_min_score"))
    beaten = good.join(judged.where("NOT kept").select("room", "id", "kept_start", "kept_end"), ID)
    dropped = dropped.unionByName(gone(beaten, "overlap", ka="kept_start", kb="kept_end")).unionByName(gone(ranked.where(F.col("rank") > settings.top_k), "top_k_cut"))
    change = lambda rows, reason, a, b: rows.select("room", "start", "end", F.bround(a, 2).alias("from_start"), F.bround(b, 2).alias("from_end"), F.lit(reason).alias("reason"), "start_source", "end_source")
    fitted = good.where("refitted AND (start <> from_start OR end <> from_end)")
    adjustments = change(fitted, "stage2_duration_fit", "from_start", "from_end").unionByName(change(good.where("moved"), "boundary_optimized", "edge_start", "edge_end"))
    best = ranked.where(F.col("rank") <= settings.top_k).drop("refitted", "moved", "from_start", "from_end", "edge_start", "edge_end")
    numbered = best.withColumn("id", F.row_number().over(Window.partitionBy("room").orderBy("start", "end")))
    return Reranked(numbered.withColumn("title", title(F.col("trigger"), F.col("start"))).withColumn("tags", tags(F.col("trigger"))), dropped, adjustments)


def rerank(candidates: DataFrame, z: DataFrame, weights: DataFrame, curve: DataFrame, asr: DataFrame | None = None, profile: str | Column = "default", low: float = 15.0, high: float = 90.0, platform: str = "none", search: float = 8.0, settings: TwoStage = TwoStage()) -> DataFrame:
    """Clips of reranked()."""
    return reranked(candidates, z, weights, curve, asr, profile, low, high, platform, search, settings).clips.drop("boundary_reasons", "reasons")


def rerank_stats(candidates: DataFrame, result: Reranked) -> DataFrame:
    """(room, candidates, kept, dropped, boundary_adjusted, content_types): what became of a room's candidates; content_types is a map of numbers of clips."""
    kinds = result.clips.groupBy("room", "content_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("boundary_reasons") > 0).alias("adjusted"))
    of_room = kinds.groupBy("room").agg(F.sum("n").alias("kept"), F.sum("adjusted").alias("boundary_adjusted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "n")))).alias("content_types"))
    out = candidates.groupBy("room").agg(F.count(F.lit(1)).alias("candidates")).join(of_room, "room", "left").join(result.dropped.groupBy("room").agg(F.count(F.lit(1)).alias("dropped")), "room", "left")
    none = F.create_map().cast("map<string,bigint>")
    return out.fillna(0, ["kept", "boundary_adjusted", "dropped"]).select("room", "candidates", "kept", "dropped", "boundary_adjusted", F.coalesce("content_types", none).alias("content_types"))
