"""Queries over normalised signals, curves and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.operators import detect, intervals, media, normalize
from tidepeak.plans import adapters as A
from tidepeak.plans.catalogue import HOT, RANGES, ROBUST, SIG, query, r6
from tidepeak.streaming import live

#: Settings for hourly ticks.
HOURLY = Scoring(sensitivity=1.0, persistence=2, min_duration=5.0, max_duration=24.0, merge_distance=3.0)
EWMA = SIG + ", e AS (SELECT a.room, a.signal, a.ord, a.t, sum(b.value * power(0.7, a.t - b.t) * CASE WHEN b.t = 0 THEN 1 ELSE 0.3 END) AS value FROM sig a JOIN sig b ON b.room = a.room AND b.signal = a.signal AND b.t <= a.t AND b.t > a.t - 100 GROUP BY ALL)"
NEAR = "JOIN {x} b ON b.room = a.room AND b.signal = a.signal AND b.t = greatest(0, least(719, a.t + o))"


def z_and_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    signals = A.signals(spark, sf)
    return normalize.robust_z(signals), normalize.profile_weights(signals)


def curve_of(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.base_score(*z_and_weights(spark, sf))


@query(EWMA + " SELECT room, signal, t, round(round(value, 9), 3) AS value FROM e")
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    # averages of prices have few digits, so finer roundings meet ties that no two orders of addition settle alike
    return normalize.ewma(A.signals(spark, sf)).select("room", "signal", "t", F.round(F.round("value", 9), 3).alias("value"))


@query(SIG + ", n AS (SELECT a.room, a.signal, a.t, any_value(a.value) AS x, avg(b.value) AS m, avg(b.value * b.value) AS q FROM sig a CROSS JOIN (SELECT unnest(range(-30, 31)) AS o) " + NEAR.format(x="sig") + " GROUP BY a.room, a.signal, a.t) SELECT room, signal, t, round(CASE WHEN sqrt(greatest(q - m * m, 0)) > 1e-6 THEN (x - m) / sqrt(greatest(q - m * m, 0)) ELSE 0 END, 5) AS z FROM n")
def rolling_z(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.rolling_z(A.signals(spark, sf), eps=1e-6).select("room", "signal", "t", F.round("value", 5).alias("z"))


@query(SIG + " SELECT a.room, a.signal, a.t, round(median(b.value), 6) AS value FROM sig a CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) " + NEAR.format(x="sig") + " GROUP BY a.room, a.signal, a.t")
def median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.median_filter(A.signals(spark, sf)).select("room", "signal", "t", r6("value").alias("value"))


@query(ROBUST + " SELECT room, signal, t, round(value, 6) AS z FROM z")
def robust_z(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.robust_z(A.signals(spark, sf)).select("room", "signal", "t", r6("value").alias("z"))


@query("""WITH days AS (SELECT ascii(l_returnflag)::BIGINT AS room, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INTEGER AS t, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT room, median(v) AS m FROM days GROUP BY room), d AS (SELECT room, any_value(m) AS m, median(abs(v - m)) AS d FROM days JOIN m USING (room) GROUP BY room)
SELECT room, t, round(greatest(-5, least(5, (v - m) / (1.4826::DOUBLE * d))), 6) AS z FROM days JOIN d USING (room)""")
def robust_z_sales(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.robust_z(A.sales(spark, sf)).select("room", "t", r6("value").alias("z"))


@query(ROBUST + " SELECT room, signal, round(w, 6) AS w FROM weights CROSS JOIN (SELECT DISTINCT room FROM sig)")
def profile_weights(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.profile_weights(A.signals(spark, sf)).select("room", "signal", r6("w").alias("w"))


@query(ROBUST + " SELECT room, t, round(score, 6) AS score FROM curve")
def base_score(spark: SparkSession, sf: str) -> DataFrame:
    return curve_of(spark, sf).select("room", "t", r6("score").alias("score"))


STEP = ROBUST + ", d AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY room, signal ORDER BY t), 0) AS d FROM z)"


@query(STEP + " SELECT room, t, round(sum(w * tanh(abs(d) / 2)), 6) AS boost FROM d JOIN weights USING (signal) GROUP BY room, t")
def change_boost(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.change_boost(*z_and_weights(spark, sf)).select("room", "t", r6("boost").alias("boost"))


@query(STEP + " SELECT room, t, round((sum(w * value) + sum(w * tanh(abs(d) / 2))) * exp(-t / 720.0::DOUBLE * 0.1::DOUBLE), 9) AS score FROM d JOIN weights USING (signal) GROUP BY room, t")
def decayed_curve(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.decayed_curve(*z_and_weights(spark, sf)).select("room", "t", "score")


@query(STEP + " SELECT room, t, round(round(sum(w * value) + 0.2::DOUBLE * tanh(sum(w * greatest(d, 0))), 9), 6) AS score FROM d JOIN weights USING (signal) GROUP BY room, t")
def recall_curve(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.recall_curve(*z_and_weights(spark, sf)).select("room", "t", r6("score").alias("score"))


@query(ROBUST + """, s AS (SELECT room, signal, any_value(ord) AS ord, avg(value) AS mean_z, max(value) AS max_z, any_value(w) * avg(abs(value)) AS c FROM z JOIN weights USING (signal) GROUP BY room, signal)
SELECT room, signal, round(mean_z, 6) AS mean_z, round(max_z, 6) AS max_z, round(c, 6) AS contribution, row_number() OVER (PARTITION BY room ORDER BY c DESC, ord)::INTEGER AS rank FROM s""")
def signal_stats(spark: SparkSession, sf: str) -> DataFrame:
    z, w = z_and_weights(spark, sf)
    return normalize.signal_stats(z, w).select("room", "signal", r6("mean_z").alias("mean_z"), r6("max_z").alias("max_z"), r6("contribution").alias("contribution"), "rank")


LAGGED = SIG + """, src AS (SELECT room, signal, ord, t, CASE WHEN signal LIKE 'dm%' THEN coalesce(lag(value, 3) OVER (PARTITION BY room, signal ORDER BY t), 0) ELSE value END AS value FROM (
  SELECT room, signal, ord, t, CASE WHEN signal LIKE 'dm%' THEN (SELECT s.value FROM sig s WHERE s.room = sig.room AND s.signal = 'rms' AND s.t = sig.t) ELSE value END AS value FROM sig))"""


@query(LAGGED + " SELECT room, signal, t, round(CASE WHEN signal LIKE 'dm%' THEN coalesce(lead(value, 3) OVER (PARTITION BY room, signal ORDER BY t), 0) ELSE value END, 6) AS value FROM src")
def lag_compensated(spark: SparkSession, sf: str) -> DataFrame:
    # chat that repeats the sound three ticks later
    from pyspark.sql import Window

    base = A.signals(spark, sf)
    rms = base.where("signal = 'rms'").select("room", "t", F.col("value").alias("r"))
    late = F.coalesce(F.lag("r", 3).over(Window.partitionBy("room", "signal").orderBy("t")), F.lit(0.0))
    src = base.join(rms, ["room", "t"]).withColumn("value", F.when(F.col("signal").startswith("dm"), late).otherwise(F.col("value"))).drop("r")
    return normalize.compensate_lag(src).select("room", "signal", "t", r6("value").alias("value"))


@query(HOT + " SELECT room, t, hot FROM hot")
def adaptive_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return detect.hot_ticks(curve_of(spark, sf), 1.0, HOURLY).select("room", "t", "hot")


@query(HOT.replace("SELECT room, t, any_value(score) AS score, bool_or(", "SELECT room, t, w, bool_or(").replace("USING (room, t) GROUP BY room, t\n", "USING (room, t) GROUP BY room, t, w\n") + " SELECT w AS scale, count(*) FILTER (hot) AS n FROM hot GROUP BY w")
def multi_scale_union(spark: SparkSession, sf: str) -> DataFrame:
    hot = detect.hot_ticks(curve_of(spark, sf), 1.0, HOURLY)
    each = F.array(*[F.struct(F.lit(w).alias("scale"), F.col(f"hot{w}").alias("hot")) for w in HOURLY.scales])
    return hot.select(F.explode(each).alias("x")).groupBy(F.col("x.scale").alias("scale")).agg(F.count_if(F.col("x.hot")).alias("n"))


@query(RANGES + " SELECT room, s::INTEGER AS \"start\", e::INTEGER AS \"end\", round(score, 6) AS score FROM ranges")
def peak_ranges(spark: SparkSession, sf: str) -> DataFrame:
    hot = detect.hot_ticks(curve_of(spark, sf), 1.0, HOURLY)
    return detect.peak_ranges(hot, 3).select("room", "start", "end", r6("score").alias("score"))


MAXIMA = """, runs AS (SELECT room, t, score, sum(new) OVER (PARTITION BY room ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN score <> lag(score) OVER (PARTITION BY room ORDER BY t) THEN 1 ELSE 0 END AS new FROM {x})),
flat AS (SELECT room, run, min(t) AS a, max(t) AS b, any_value(score) AS score FROM runs GROUP BY room, run),
peak AS (SELECT room, ((a + b) // 2)::INTEGER AS t, score FROM (SELECT *, lag(score) OVER w AS l, lead(score) OVER w AS r FROM flat WINDOW w AS (PARTITION BY room ORDER BY run)) WHERE score > l AND score > r)"""


@query(ROBUST + MAXIMA.format(x="curve") + " SELECT room, t, round(score, 6) AS score FROM peak")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return detect.local_maxima(curve_of(spark, sf)).select("room", "t", r6("score").alias("score"))


@query(SIG + ", ones AS (SELECT room, t, value AS score FROM sig WHERE signal = 'dmDensity')" + MAXIMA.format(x="ones") + " SELECT room, t, score FROM peak WHERE score >= 3")
def plateau_peaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.signals(spark, sf).where("signal = 'dmDensity'").select("room", "t", F.col("value").alias("score"))
    return detect.peaks(rows, 1, height=3.0)


FAR = """, o AS (SELECT room, t, score, row_number() OVER (PARTITION BY room ORDER BY score DESC, t DESC) AS i FROM peak),
rec AS (SELECT room, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT room FROM o) UNION ALL
  SELECT o.room, o.i, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - o.t) < 12)) = 0 THEN list_append(r.kept, o.t::BIGINT) ELSE r.kept END FROM rec r JOIN o ON o.room = r.room AND o.i = r.i + 1),
far AS (SELECT room, unnest(kept) AS t FROM (SELECT room, arg_max(kept, i) AS kept FROM rec GROUP BY room)),
base AS (SELECT f.room, f.t, c.score, coalesce((SELECT max(x.t) FROM curve x WHERE x.room = f.room AND x.t < f.t AND x.score > c.score), -1) AS l, coalesce((SELECT min(x.t) FROM curve x WHERE x.room = f.room AND x.t > f.t AND x.score > c.score), 720) AS r FROM far f JOIN curve c ON c.room = f.room AND c.t = f.t),
prom AS (SELECT room, t, score, score - greatest((SELECT min(x.score) FROM curve x WHERE x.room = b.room AND x.t > b.l AND x.t <= b.t), (SELECT min(x.score) FROM curve x WHERE x.room = b.room AND x.t >= b.t AND x.t < b.r)) AS p FROM base b)
SELECT room, t::INTEGER AS t, round(score, 6) AS score FROM prom WHERE p >= 0.8"""


@query((ROBUST + MAXIMA.format(x="curve") + FAR).replace("WITH ev", "WITH RECURSIVE ev", 1))
def peaks_distance_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return detect.peaks(curve_of(spark, sf), 12, prominence=0.8).withColumn("score", r6("score"))


@query()
def anchor_merge(spark: SparkSession, sf: str) -> DataFrame:
    z, w = z_and_weights(spark, sf)
    curve = normalize.recall_curve(z, w)
    settings = TwoStage(min_gap=6)
    rows = detect.merge_anchors(detect.anchors(curve, z, w, settings), intervals.sizes(curve), settings)
    return rows.select("room", "t", r6("score").alias("score"), F.array_join("anchors", ",").alias("anchors"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query(ROBUST + MAXIMA.format(x="curve") + " SELECT room, t, round_even(greatest(0, least(t - 12, 696)), 2)::DOUBLE AS \"start\", round_even(greatest(0, least(t - 12, 696)) + 24, 2)::DOUBLE AS \"end\" FROM peak")
def candidate_windows(spark: SparkSession, sf: str) -> DataFrame:
    start, end = detect.make_window(F.col("t"), F.lit(720), 5.0, 24.0, 30.0)
    return detect.local_maxima(curve_of(spark, sf)).select("room", "t", start.alias("start"), end.alias("end"))


@query(ROBUST + MAXIMA.format(x="curve") + """, s AS (SELECT DISTINCT p.room, p.t, z.signal FROM peak p JOIN z ON z.room = p.room AND z.t BETWEEN p.t - 1 AND p.t + 1 WHERE z.value >= 1)
SELECT p.room, p.t, coalesce(string_agg(signal, ',' ORDER BY signal), '') AS sources FROM peak p LEFT JOIN s USING (room, t) GROUP BY p.room, p.t""")
def source_attribution(spark: SparkSession, sf: str) -> DataFrame:
    z, w = z_and_weights(spark, sf)
    places = detect.local_maxima(normalize.base_score(z, w))
    return detect.sources_at(places, z, w).select("room", "t", F.array_join("sources", ",").alias("sources"))


@query(SIG + ", r AS (SELECT room, t, value FROM sig WHERE signal = 'rms') SELECT room, t, round(value, 6) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY room) + 2 * stddev_pop(value) OVER (PARTITION BY room) AS l FROM r) WHERE value > l")
def loud_ticks(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.signals(spark, sf).where("signal = 'rms'").select("room", "t", "value")
    return media.loud_ticks(rows).select("room", "t", r6("value").alias("value"))


@query(SIG + """, g AS (SELECT room, t FROM sig WHERE signal = 'sceneChange' AND value >= 0.5), k AS (
  SELECT room, list_reduce(list_prepend([]::DOUBLE[], list_transform(list(t ORDER BY t), lambda x: [x::DOUBLE])), lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[len(a)] >= 5 THEN list_concat(a, x) ELSE a END) AS kept FROM g GROUP BY room)
SELECT room, unnest(kept) AS t FROM k""")
def spaced_cuts(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.signals(spark, sf).where("signal = 'sceneChange'").select("room", "t", "value")
    return media.scene_cuts(rows, 0.5, 5.0)


@query("SELECT vec_id AS frame, round(coalesce(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(embedding[i]::DOUBLE - b[i]::DOUBLE, 2)))), 0), 6) AS value FROM (SELECT *, lag(embedding) OVER (PARTITION BY vec_id // 900 ORDER BY vec_id) AS b FROM embeddings)")
def vector_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 900).alias("room"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("vec"))
    return media.vector_change(rows).select("frame", r6("value").alias("value"))


# ── streams: the same functions on a stored table, and one run as a stream ──
@query(RANGES + " SELECT room, s::BIGINT AS \"start\", e::BIGINT AS last, round(score, 6) AS score FROM ranges")
def session_ranges(spark: SparkSession, sf: str) -> DataFrame:
    hot = detect.hot_ticks(curve_of(spark, sf), 1.0, HOURLY).where("hot").withColumn("ts", F.timestamp_seconds(F.col("t").cast("long")))
    rows = live.session_ranges(hot.select("room", "ts", "score"), "3500 milliseconds")
    return rows.select("room", F.unix_seconds("start").alias("start"), F.unix_seconds("last").alias("last"), r6("score").alias("score"))


COUNTS = "SELECT user_id % 5 AS room, floor(epoch(ts) / 3600)::BIGINT * 3600 AS \"start\", count(*) AS n FROM events GROUP BY ALL"


@query(COUNTS)
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return live.tumbling_counts(A.events(spark, sf), "1 hour").select("room", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "n")


@query("""SELECT room, o * 3600 + h AS "start", count(*) AS n FROM (SELECT user_id % 5 AS room, floor(epoch(ts) / 3600)::BIGINT * 3600 AS h FROM events) CROSS JOIN (SELECT unnest(range(-10, 1)) AS o) GROUP BY ALL""")
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return live.sliding_counts(A.events(spark, sf), "11 hours", "1 hour").select("room", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "n")


@query("SELECT user_id % 5 AS room, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def method_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.events(spark, sf).groupBy("room", "type").agg(F.count(F.lit(1)).alias("n"))
