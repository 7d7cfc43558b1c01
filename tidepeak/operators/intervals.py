"""Intervals (room, id, start, end, score) from peaks: boundaries, expansion, merging, quality, explanation.

Intervals meet ticks by an equi-join: they are exploded to their ticks, which their duration bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.config import Scoring

#: Titles by the first part that a trigger contains, and tags by all parts.
TITLES = (
    (("asrKeyword",), "💬 关键词片段"), (("eventLaughter",), "😂 搞笑高能"), (("eventApplause",), "👏 精彩时刻"), (("dmDensity", "dmAcceleration"), "🔥 弹幕爆发"),
    (("speakerChange",), "🗣 连麦高光"), (("rms",), "🔊 音量爆发"), (("motion",), "📹 画面高能"),
)
OTHER_TITLE, OTHER_TAG = "📹 高光时刻", "高光"
TAGS = (("asrKeyword", "关键词"), ("eventLaughter", "搞笑"), ("eventApplause", "精彩"), ("dmDensity", "互动"), ("dmAcceleration", "爆发"), ("speakerChange", "连麦"), ("rms", "音量"), ("motion", "动作"), ("sceneChange", "场景"))


def ticks(intervals: DataFrame, first: Column, last: Column, name: str = "t") -> DataFrame:
    """Intervals exploded to ticks first to last, both included; without any if last is less."""
    return intervals.withColumn("_a", first.cast("int")).withColumn("_b", last.cast("int")).where("_a <= _b").withColumn(name, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def sizes(curve: DataFrame) -> DataFrame:
    return curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))


def valleys(z: DataFrame, radius: int = 5) -> DataFrame:
    """(room, t) where loudness is below its mean over [t - radius, t + radius)."""
    w = Window.partitionBy("room").orderBy("t").rowsBetween(-radius, radius - 1)
    return z.where("signal = 'rms'").withColumn("m", F.avg("value").over(w)).where("value < m").select("room", "t")


def gathered(rows: DataFrame, like: DataFrame, *aggregates: Column) -> DataFrame:
    """Exploded rows back to one for each (room, id), with the columns of `like` and aggregates."""
    return rows.groupBy("room", "id").agg(*[F.first(c).alias(c) for c in like.columns if c not in ("room", "id")], *aggregates)


def valley_bounds(intervals: DataFrame, z: DataFrame, n: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Starts moved to the farthest valley before, ends to the nearest valley after, or both by a fixed pad."""
    quiet = valleys(z, settings.valley_radius).withColumn("quiet", F.lit(True))
    r = settings.valley_range
    first, last = F.col("start").cast("int"), F.col("end").cast("int")
    around = F.concat(F.sequence(first - r, first - 1), F.sequence(last, last + (r - 1)))
    spread = intervals.withColumn("t", F.explode(around)).join(quiet, ["room", "t"], "left")
    before = F.min(F.when(F.col("quiet") & (F.col("t") < F.col("start")), F.col("t"))).alias("left")
    after = F.min(F.when(F.col("quiet") & (F.col("t") >= F.col("end")), F.col("t"))).alias("right")
    joined = gathered(spread, intervals, before, after).join(n, "room")
    start = F.greatest(F.lit(0.0), F.coalesce(F.col("left").cast("double"), F.greatest(F.lit(0.0), F.col("start") - settings.pad)))
    end = F.least(F.col("n").cast("double"), F.coalesce(F.col("right").cast("double"), F.col("end") + settings.pad))
    return joined.select("room", "id", start.alias("start"), end.alias("end"), "score")


def clamp(intervals: DataFrame, n: DataFrame) -> DataFrame:
    """Ends rounded (half to even) into the recording, in order."""
    inside = lambda c: F.greatest(F.lit(0), F.least(F.bround(F.col(c)).cast("int"), F.col("n").cast("int")))
    rows = intervals.join(n, "room").withColumn("_s", inside("start")).withColumn("_e", inside("end"))
    return rows.withColumns({"start": F.least("_s", "_e").cast("double"), "end": F.greatest("_s", "_e").cast("double")}).select(*intervals.columns)


def best_subwindow(intervals: DataFrame, curve: DataFrame, longest: float) -> DataFrame:
    """Intervals longer than `longest` cut to the part of that length with the highest sum of scores, the first of equals."""
    size = round(longest)
    ahead = Window.partitionBy("room").orderBy("t").rowsBetween(0, size - 1)
    sums = curve.select("room", F.col("t").alias("_at"), F.round(F.sum("score").over(ahead), 9).alias("_held"))
    places = F.when(F.col("end") - F.col("start") > longest, F.sequence(F.col("start").cast("int"), F.greatest(F.col("start").cast("int"), (F.col("end") - size).cast("int"))))
    placed = intervals.withColumn("_at", F.explode_outer(places)).join(sums, ["room", "_at"], "left")
    order = F.when(F.col("_held").isNotNull(), F.struct("_held", (-F.col("_at"))))
    moved = gathered(placed, intervals, F.max_by("_at", order).alias("_best"))
    return moved.withColumns({"start": F.coalesce(F.col("_best").cast("double"), "start"), "end": F.coalesce((F.col("_best") + size).cast("double"), "end")}).select(*intervals.columns)


def widen(intervals: DataFrame, n: DataFrame, least: float) -> DataFrame:
    """Intervals shorter than `least` widened around their middle, inside the recording; all of a short one."""
    need = -int(-least // 1)
    middle = F.bround((F.col("start") + F.col("end")) / 2 - need / 2)
    start = F.greatest(F.lit(0.0), F.least(middle.cast("double"), (F.col("n") - need).cast("double")))
    short = (F.col("end") - F.col("start")) < least
    whole = F.col("n") <= least
    rows = intervals.join(n, "room").withColumn("_s", F.when(short & whole, 0.0).when(short, start).otherwise(F.col("start")))
    end = F.when(short & whole, F.col("n").cast("double")).when(short, F.col("_s") + need).otherwise(F.col("end"))
    return rows.withColumn("end", end).withColumn("start", F.col("_s")).select(*intervals.columns)


def expand(intervals: DataFrame, curve: DataFrame, least: float, longest: float, n: DataFrame | None = None) -> DataFrame:
    """Peak ranges made publishable: an empty one lasts a tick, short ones are widened, long ones cut to their best part."""
    n = sizes(curve) if n is None else n
    rows = clamp(intervals, n).join(n, "room").withColumn("end", F.when(F.col("end") <= F.col("start"), F.least(F.col("n").cast("double"), F.col("start") + 1)).otherwise(F.col("end"))).drop("n")
    return best_subwindow(widen(rows, n, least), curve, longest)


def merge_near(intervals: DataFrame, distance: float = 15.0) -> DataFrame:
    """Intervals that start less than `distance` after an earlier end, merged: outermost bounds, highest score.

    An island starts where a start is far enough from every earlier end, so a running maximum finds them.
    """
    order = Window.partitionBy("room").orderBy("start", "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.coalesce((F.col("start") - reach >= distance).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(order))
    merged = marked.groupBy("room", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return merged.withColumn("id", F.row_number().over(Window.partitionBy("room").orderBy("start"))).select("room", "id", "start", "end", "score")


def merged_away(intervals: DataFrame, distance: float = 15.0) -> DataFrame:
    """Intervals that merge_near() took into an earlier one, as duplicates."""
    order = Window.partitionBy("room").orderBy("start", "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("reach", reach).where(F.col("start") - F.col("reach") < distance).select("room", F.bround("start", 1).alias("start"), F.bround("end", 1).alias("end"), F.bround("score", 3).alias("score"), F.lit("duplicate").alias("reason"))


def t_test_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite series in the angle atan(|t| / sqrt(freedom))."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    square = F.pow(F.cos(angle), F.lit(2))
    terms = F.floor((freedom - 2 + F.pmod(freedom, F.lit(2)) * -1) / 2).cast("int")  # terms after the first
    odd = F.pmod(freedom, F.lit(2)) == 1

    def series(ratio: object) -> Column:
        start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * square * ratio(k)
            return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

        return F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda acc: acc["sum"])).otherwise(1.0)

    even_part = F.sin(angle) * series(lambda k: (2 * k - 1) / (2 * k))
    odd_sum = F.when(freedom > 1, F.sin(angle) * F.cos(angle) * series(lambda k: (2 * k) / (2 * k + 1))).otherwise(0.0)
    return 1 - F.when(odd, 2 / F.pi() * (angle + odd_sum)).otherwise(even_part)


def with_p(intervals: DataFrame, curve: DataFrame, before: int = 5) -> DataFrame:
    """Adds p and tested: pooled t-test of the scores in each interval against those just before it, if there are over two of both."""
    first, last = F.greatest(F.lit(0), F.col("start").cast("int") - before), F.col("end").cast("int") - 1
    spread = intervals.withColumn("t", F.explode_outer(F.when(first <= last, F.sequence(first, last)))).join(curve.select("room", "t", F.col("score").alias("_s")), ["room", "t"], "left")
    inside = F.col("t") >= F.col("start").cast("int")
    of = lambda f, flag: f(F.when(flag, F.col("_s")))
    stats = gathered(
        spread, intervals, of(F.count, inside).alias("n1"), of(F.avg, inside).alias("m1"), of(F.var_samp, inside).alias("v1"),
        of(F.count, ~inside).alias("n2"), of(F.avg, ~inside).alias("m2"), of(F.var_samp, ~inside).alias("v2"),
    )
    freedom = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / freedom
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    tested = (F.col("n1") > 2) & (F.col("n2") > 2)
    return stats.withColumn("tested", tested).withColumn("p", F.when(F.col("tested"), t_test_p(t, freedom))).select(*intervals.columns, "p", "tested")


def t_tests(intervals: DataFrame, curve: DataFrame, before: int = 5) -> DataFrame:
    """(room, id, p) of the intervals that have enough scores for with_p()."""
    return with_p(intervals.select("room", "id", "start", "end"), curve, before).where("tested").select("room", "id", "p")


def penalise(intervals: DataFrame, curve: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Scores lowered where the t-test finds no difference; equal variances of zero find neither."""
    weak = F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") > settings.p_value)
    rows = with_p(intervals, curve, settings.before).drop("tested")
    return rows.withColumn("score", F.when(weak, F.col("score") * settings.penalty).otherwise(F.col("score")))


def judged(intervals: DataFrame, curve: DataFrame, settings: Scoring = Scoring(), n: DataFrame | None = None) -> DataFrame:
    """Intervals cut or widened to fit, insignificant ones penalised, with what happened to each: those that have to go are marked, too.

    Adds p, from_start and from_end (as they were inside the recording), and reasons, in order: too_short (of one that
    goes), trimmed_too_long, insufficient_context (the recording itself is too short), t_test_insignificant.
    """
    n = sizes(curve) if n is None else n
    rows = clamp(intervals, n).withColumns({"from_start": F.col("start"), "from_end": F.col("end")})
    fit = widen(best_subwindow(rows, curve, settings.max_duration), n, settings.min_duration)
    tested = with_p(fit, curve, settings.before).drop("tested").join(n, "room")
    length = F.col("from_end") - F.col("from_start")
    empty = length <= 0
    short = F.when(length > settings.max_duration, float(round(settings.max_duration))).otherwise(length) < settings.min_duration
    whole = ~empty & short & (F.col("n") <= settings.min_duration)
    gone = empty | (F.col("end") - F.col("start") < settings.min_duration)
    weak = ~gone & F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") > settings.p_value)
    found = ((gone, "too_short"), (~empty & (length > settings.max_duration), "trimmed_too_long"), (whole, "insufficient_context"), (weak, "t_test_insignificant"))
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in found]), lambda x: x.isNotNull())
    return tested.withColumn("reasons", reasons).withColumn("score", F.when(weak, F.col("score") * settings.penalty).otherwise(F.col("score"))).drop("n")


def quality(intervals: DataFrame, curve: DataFrame, settings: Scoring = Scoring(), n: DataFrame | None = None) -> DataFrame:
    """Intervals of judged() that stay; p says why a score is lower."""
    return judged(intervals, curve, settings, n).where(~F.array_contains("reasons", "too_short")).select(*intervals.columns, "p")


def signal_stats(intervals: DataFrame, z: DataFrame) -> DataFrame:
    """(room, id, signal, ord, peak, mean) of every signal within each interval."""
    held = ticks(intervals.select("room", "id", "start", "end"), F.col("start").cast("int"), F.ceil("end").cast("int") - 1)
    return held.join(z, ["room", "t"]).groupBy("room", "id", "signal", "ord").agg(F.max("value").alias("peak"), F.avg("value").alias("mean"))


def with_trigger(intervals: DataFrame, z: DataFrame, limit: float = 2.0) -> DataFrame:
    """Adds trigger: names of all signals over the limit within each interval, weighted or not, joined by +."""
    first, last = F.col("start").cast("int"), F.ceil("end").cast("int") - 1
    high = z.where(F.col("value") > limit).groupBy("room", "t").agg(F.collect_list(F.struct("ord", "signal")).alias("_high"))
    spread = intervals.withColumn("t", F.explode_outer(F.when(first <= last, F.sequence(first, last)))).join(high, ["room", "t"], "left")
    named = gathered(spread, intervals, F.array_sort(F.array_distinct(F.flatten(F.collect_list("_high")))).alias("_names"))
    trigger = F.array_join(F.transform("_names", lambda x: x["signal"]), "+")
    return named.withColumn("trigger", F.coalesce(F.nullif(trigger, F.lit("")), F.lit("unknown"))).drop("_names")


def triggers(intervals: DataFrame, z: DataFrame, limit: float = 2.0) -> DataFrame:
    """(room, id, trigger) of with_trigger()."""
    return with_trigger(intervals.select("room", "id", "start", "end"), z, limit).select("room", "id", "trigger")


def title(trigger: Column, start: Column) -> Column:
    """The title of the first rule one of whose parts the trigger contains, with the second it starts."""
    name = F.lit(OTHER_TITLE)
    for parts, text in reversed(TITLES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | trigger.contains(p)
        name = F.when(hit, F.lit(text)).otherwise(name)
    return F.concat(name, F.lit(" ("), start.cast("int").cast("string"), F.lit("s)"))


def tags(trigger: Column) -> Column:
    found = F.filter(F.array(*[F.when(trigger.contains(k), F.lit(v)) for k, v in TAGS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_TAG)))


def breakdown(intervals: DataFrame, z: DataFrame, weights: DataFrame, top: int = 5) -> DataFrame:
    """(room, id, signal, contribution, rank): the largest weighted mean values within each interval."""
    parts = signal_stats(intervals, z).join(weights, ["room", "signal"]).withColumn("contribution", F.round(F.col("w") * F.col("mean"), 4))
    rank = F.row_number().over(Window.partitionBy("room", "id").orderBy(F.desc(F.abs("contribution")), "ord"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= top).select("room", "id", "signal", "contribution", "rank")


def number(ranges: DataFrame) -> DataFrame:
    """Ranges as intervals with an id by start."""
    order = Window.partitionBy("room").orderBy("start", "end")
    return ranges.select("room", F.row_number().over(order).alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "score")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; 0 if they are apart."""
    common = overlap(a_start, a_end, b_start, b_end)
    return F.coalesce(F.try_divide(common, (a_end - a_start) + (b_end - b_start) - common), F.lit(0.0))
