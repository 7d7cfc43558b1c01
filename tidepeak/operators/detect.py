"""Peaks and candidates of curves (room, t, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.functions.settle import settle
from tidepeak.functions.windows import nearest_mean
from tidepeak.schema import ANCHORS, room_type

KEY = ["room"]
#: Anchor name of the fused curve's own peaks.
CURVE = "recallCurve"


def hot_ticks(curve: DataFrame, k: float, settings: Scoring = Scoring()) -> DataFrame:
    """Curve with a flag per scale and `hot`: score over mean + k * deviation of the frame [t - w, t + w - 1], and so for
    `persistence` ticks, all against the threshold of the first. Scales of which two do not fit are left out."""
    time = Window.partitionBy("room").orderBy("t")
    x = F.col("score")
    out = curve.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("room")))
    frames = {f"m{w}": nearest_mean(x, w, w - 1, KEY) for w in settings.scales} | {f"q{w}": nearest_mean(x * x, w, w - 1, KEY) for w in settings.scales}
    ahead = {f"s{i}": F.lead(x, i).over(time) for i in range(1, settings.persistence)}
    out = out.withColumns(frames | ahead)
    flags = {}
    for w in settings.scales:
        mean = F.col(f"m{w}")
        # by more than rounding, so that flat stretches are never hot
        limit = mean + k * F.sqrt(F.greatest(F.col(f"q{w}") - mean * mean, F.lit(0.0))) + 1e-9
        hot = (2 * w < F.col("n")) & (x > limit)
        for i in range(1, settings.persistence):
            hot = hot & F.coalesce(F.col(f"s{i}") > limit, F.lit(False))
        flags[f"hot{w}"] = hot
    out = out.withColumns(flags)
    anyhot = F.lit(False)
    for w in settings.scales:
        anyhot = anyhot | F.col(f"hot{w}")
    return out.withColumn("hot", anyhot).drop("n", *frames, *ahead)


def peak_ranges(hot: DataFrame, gap: int = 3) -> DataFrame:
    """(room, start, end, score) of runs of hot ticks at most `gap` apart; the end is the last hot tick."""
    time = Window.partitionBy("room").orderBy("t")
    rows = hot.where("hot").select("room", "t", "score").withColumn("new", (F.col("t") - F.lag("t").over(time) > gap).cast("int"))
    runs = rows.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(time))
    return runs.groupBy("room", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("score").alias("score")).drop("run")


def local_maxima(curve: DataFrame) -> DataFrame:
    """(room, t, score): places higher than both neighbours; of a plateau its middle (the earlier one); the ends are none."""
    time = Window.partitionBy("room").orderBy("t")
    runs = curve.withColumn("new", F.coalesce((F.col("score") != F.lag("score").over(time)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(time))
    flat = runs.groupBy("room", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.first("score").alias("score"))
    order = Window.partitionBy("room").orderBy("run")
    peaks = flat.withColumn("left", F.lag("score").over(order)).withColumn("right", F.lead("score").over(order)).where("score > left AND score > right")
    return peaks.select("room", F.expr("(a + b) DIV 2").cast("int").alias("t"), "score")


def find_peaks(x: np.ndarray, distance: int = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Places of local maxima, at least `height` high, then thinned by distance from higher ones, then by prominence.

    Of equally high peaks that are too close, the later one stays.
    """
    x = np.asarray(x, float)
    change = np.flatnonzero(np.diff(x))
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[starts] if len(x) else x
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.array([], int)
    peaks = (starts[inner] + ends[inner]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        alive = np.ones(len(peaks), bool)
        for i in sorted(range(len(peaks)), key=lambda i: (-x[peaks[i]], -i)):
            if alive[i]:
                near = np.abs(peaks - peaks[i]) < distance
                near[i] = False
                alive &= ~near
        peaks = peaks[alive]
    if prominence is not None:
        kept = []
        for p in peaks:
            higher = np.flatnonzero(x > x[p])
            left = higher[higher < p].max(initial=-1)
            right = higher[higher > p].min(initial=len(x))
            if x[p] - max(x[left + 1 : p + 1].min(), x[p:right].min()) >= prominence:
                kept.append(p)
        peaks = np.array(kept, int)
    return peaks


def peaks(curve: DataFrame, distance: int, height: float | None = None, prominence: float | None = None, keys: tuple[str, ...] = ("room",), value: str = "score") -> DataFrame:
    """Rows of curve at find_peaks(); thinning is sequential, so each curve is one group (one number a tick)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return rows.iloc[find_peaks(rows[value].to_numpy(), distance, height, prominence)]

    return curve.groupBy(*keys).applyInPandas(run, curve.schema)


def budget(n: Column, per_hour: float) -> Column:
    """How many candidates a recording of n seconds may have."""
    return F.greatest(F.lit(1), F.ceil(per_hour * F.greatest(n / 3600.0, F.lit(1 / 60)))).cast("int")


def anchors(curve: DataFrame, z: DataFrame, weights: DataFrame, settings: TwoStage = TwoStage()) -> DataFrame:
    """(room, t, score, anchor): peaks of the curve and of weighted anchor signals; without any, the highest positive ticks."""
    of_curve = peaks(curve, max(1, round(settings.min_gap)), prominence=settings.prominence).select("room", "t", "score", F.lit(CURVE).alias("anchor"))
    own = z.where(F.col("signal").isin(*ANCHORS)).join(weights, ["room", "signal"], "left_semi").select("room", "t", "signal", "value")
    of_signals = peaks(own, max(1, round(settings.min_gap / 2)), height=settings.agreement_z, keys=("room", "signal"), value="value").select("room", "t", F.col("signal").alias("anchor"))
    found = of_curve.unionByName(of_signals.join(curve, ["room", "t"]).select("room", "t", "score", "anchor"))
    n = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    bare = curve.where("score > 0").join(found.select("room").distinct(), "room", "left_anti").join(n, "room")
    order = Window.partitionBy("room").orderBy(F.desc("score"), F.desc("t"))
    fallback = bare.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget(F.col("n"), settings.per_hour))
    return found.unionByName(fallback.select("room", "t", "score", F.lit(CURVE).alias("anchor")))


def merge_anchors(found: DataFrame, sizes: DataFrame, settings: TwoStage = TwoStage()) -> DataFrame:
    """(room, t, score, anchors, places): the best anchors at least min_gap apart, up to each room's budget.

    Anchors near a chosen one merge into it, also after the budget is used up. Greedy by score, one group a
    room: anchors are few, as peaks keep their distance.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cap = int(rows["cap"].iloc[0])
        rows = rows.assign(score=rows["score"].round(6), plain=(rows["anchor"] == CURVE).astype(int))
        rows = rows.sort_values(["score", "plain", "t", "anchor"], ascending=[False, True, True, True], kind="stable")
        chosen: list[dict] = []
        for r in rows.itertuples():
            near = next((c for c in chosen if abs(c["t"] - r.t) < settings.min_gap), None)
            if near is not None:
                near["score"] = max(near["score"], r.score)
                near["places"].append(r.t)
                near["anchors"].append(r.anchor)
            elif len(chosen) < cap:
                chosen.append({"room": r.room, "t": r.t, "score": r.score, "anchors": [r.anchor], "places": [r.t]})
        for c in chosen:
            c["anchors"] = sorted(set(c["anchors"]))
        return pd.DataFrame(chosen, columns=["room", "t", "score", "anchors", "places"])

    capped = found.join(sizes, "room").withColumn("cap", budget(F.col("n"), settings.per_hour))
    return capped.groupBy("room").applyInPandas(run, f"room {room_type(found)}, t int, score double, anchors array<string>, places array<int>")


def make_window(at: Column, n: Column, low: float, high: float, target: float = 30.0) -> tuple[Column, Column]:
    """(start, end) of about `target` seconds around a place, shifted inside the recording; all of a short one."""
    n = n.cast("double")
    length = F.least(F.lit(float(min(high, max(low, target)))), n)
    start = F.greatest(F.lit(0.0), F.least(at - length / 2, n - length))
    whole = n <= low
    return F.when(whole, 0.0).otherwise(F.bround(start, 2)), F.when(whole, n).otherwise(F.bround(start + length, 2))


def sources_at(places: DataFrame, z: DataFrame, weights: DataFrame, limit: float = 1.0) -> DataFrame:
    """(room, t, sources): names of weighted signals that reach the limit within a tick of each place, in order of name."""
    asked = places.select("room", F.col("t").alias("at")).distinct()
    near = asked.select("room", "at", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("t"))
    active = z.where(F.col("value") >= limit).join(weights, ["room", "signal"]).select("room", "t", "signal")
    found = near.join(active, ["room", "t"]).groupBy("room", "at").agg(F.array_sort(F.collect_set("signal")).alias("sources"))
    return asked.join(found, ["room", "at"], "left").select("room", F.col("at").alias("t"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def recall(curve: DataFrame, z: DataFrame, weights: DataFrame, low: float, high: float, settings: TwoStage = TwoStage()) -> DataFrame:
    """Candidates (room, id, start, end, score, sources) of the first stage."""
    n = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    merged = settle(merge_anchors(settle(anchors(curve, z, weights, settings)), n, settings))
    place = merged.select("room", F.col("t").alias("centre"), F.posexplode("places").alias("pos", "t"))
    near = place.join(sources_at(place, z, weights, settings.agreement_z), ["room", "t"])
    of_places = near.groupBy("room", "centre").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sources"))), lambda x: x["sources"])).alias("near"))
    named = merged.withColumnRenamed("t", "centre").join(of_places, ["room", "centre"]).join(n, "room")
    start, end = make_window(F.col("centre"), F.col("n"), low, high, settings.window)
    sources = F.array_distinct(F.concat(F.array_except("anchors", F.array(F.lit(CURVE))), "near"))
    rows = named.select("room", start.alias("start"), end.alias("end"), "score", F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(CURVE))).alias("sources"))
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("room").orderBy("start", "end")))
