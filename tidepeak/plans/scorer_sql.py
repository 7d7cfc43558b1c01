"""SQL twin of the whole point scorer, put together of the twins of its steps, and the query that it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.config import Scoring
from tidepeak.plans import adapters as A
from tidepeak.plans import highlights
from tidepeak.plans.catalogue import HOT, RANGES, ROBUST, SIG, query, r6
from tidepeak.plans.queries_intervals import EXPAND, MERGE, TTEST, VALLEY

#: Signals that are never flat for long: where deviations are all but nothing, z is a ratio of roundings that no two engines share.
DENSE = ("rms", "dmDensity", "dmUniqueUsers")
SETTINGS = Scoring(sensitivity=1.0, persistence=2, min_duration=5.0, max_duration=24.0, merge_distance=3.0)

PREPARED = SIG + """, dense AS (SELECT * FROM sig WHERE signal IN ('rms', 'dmDensity', 'dmUniqueUsers')
), e AS (
  SELECT a.room, a.signal, a.ord, a.t, sum(b.value * power(0.7, a.t - b.t) * CASE WHEN b.t = 0 THEN 1 ELSE 0.3 END) AS value FROM dense a JOIN dense b ON b.room = a.room AND b.signal = a.signal AND b.t <= a.t AND b.t > a.t - 100 GROUP BY ALL
), n61 AS (
  SELECT a.room, a.signal, a.ord, a.t, any_value(a.value) AS x, avg(b.value) AS m, avg(b.value * b.value) AS q FROM e a CROSS JOIN (SELECT unnest(range(-30, 31)) AS o) JOIN e b ON b.room = a.room AND b.signal = a.signal AND b.t = greatest(0, least(719, a.t + o)) GROUP BY a.room, a.signal, a.ord, a.t
), rz AS (
  SELECT room, signal, ord, t, CASE WHEN sqrt(greatest(q - m * m, 0)) > 1e-10 THEN (x - m) / sqrt(greatest(q - m * m, 0)) ELSE 0 END AS value FROM n61
), mz AS (
  SELECT a.room, a.signal, a.ord, a.t, median(b.value) AS value FROM rz a CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) JOIN rz b ON b.room = a.room AND b.signal = a.signal AND b.t = greatest(0, least(719, a.t + o)) GROUP BY a.room, a.signal, a.ord, a.t
), pair AS (
  SELECT room, signal, t, value - avg(value) OVER (PARTITION BY room, signal) AS v FROM mz WHERE signal IN ('dmDensity', 'rms')
), corr AS (
  SELECT a.room, a.t - b.t AS k, sum(a.v * b.v) AS c FROM pair a JOIN pair b ON b.room = a.room AND a.signal = 'dmDensity' AND b.signal = 'rms' GROUP BY ALL
), shift AS (
  SELECT room, CASE WHEN abs(arg_max(k, c)) BETWEEN 1 AND 5 THEN arg_max(k, c) ELSE 0 END AS k FROM corr GROUP BY room
), z AS (
  SELECT m.room, m.signal, m.ord, m.t, CASE WHEN m.signal LIKE 'dm%' THEN coalesce(x.value, 0) ELSE m.value END AS value FROM mz m JOIN shift s ON s.room = m.room LEFT JOIN mz x ON x.room = m.room AND x.signal = m.signal AND x.t = m.t + s.k
), weights AS (
  SELECT signal, x / 0.3::DOUBLE AS w FROM (VALUES ('rms', 0.10::DOUBLE), ('dmDensity', 0.15::DOUBLE), ('dmUniqueUsers', 0.05::DOUBLE)) v(signal, x)
), d AS (
  SELECT *, coalesce(value - lag(value) OVER (PARTITION BY room, signal ORDER BY t), 0) AS d FROM z
), curve AS (
  SELECT room, t, round((sum(w * value) + sum(w * tanh(abs(d) / 2))) * exp(-t / 720.0::DOUBLE * 0.1::DOUBLE), 9) AS score FROM d JOIN weights USING (signal) GROUP BY room, t
)"""
CANDIDATES = PREPARED + HOT[len(ROBUST) :] + RANGES[len(HOT) :] + VALLEY[len(RANGES) :] + EXPAND.replace("FROM ranges", "FROM bounds") + MERGE + """, clip AS (
  SELECT room, row_number() OVER (PARTITION BY room ORDER BY s) AS id, s, e, score FROM final
)"""
JUDGED = CANDIDATES + TTEST[len(RANGES + EXPAND) :].replace("FROM fit w", "FROM clip w")
POINTS = JUDGED + """, high AS (SELECT c.room, c.id, string_agg(DISTINCT signal, '+' ORDER BY signal) AS names, max((signal = 'dmDensity')::INTEGER) AS dens, max((signal = 'rms')::INTEGER) AS loud, max((signal = 'dmUniqueUsers')::INTEGER) AS users FROM clip c JOIN z ON z.room = c.room AND z.t >= c.s AND z.t < c.e WHERE z.value > 2 GROUP BY c.room, c.id
), shown AS (
  SELECT c.room, c.id, c.s, c.e, CASE WHEN p > 0.05 THEN c.score * 0.7 ELSE c.score END AS score, p, coalesce(dens, 0) AS dens, coalesce(loud, 0) AS loud,
    coalesce(nullif(concat_ws('+', CASE WHEN loud = 1 THEN 'rms' END, CASE WHEN dens = 1 THEN 'dmDensity' END, CASE WHEN users = 1 THEN 'dmUniqueUsers' END), ''), 'unknown') AS trigger FROM clip c LEFT JOIN pv USING (room, id) LEFT JOIN high USING (room, id)
)
SELECT room, id::INTEGER AS id, s AS "start", e AS "end", round(score, 6) AS score, round(p, 6) AS p, trigger, CASE WHEN dens = 1 THEN '🔥 弹幕爆发' WHEN loud = 1 THEN '🔊 音量爆发' ELSE '📹 高光时刻' END || ' (' || s::INTEGER || 's)' AS title,
  CASE WHEN dens + loud = 0 THEN '高光' ELSE concat_ws(',', CASE WHEN dens = 1 THEN '互动' END, CASE WHEN loud = 1 THEN '音量' END) END AS tags, s + 3 AS thumbnail FROM shown"""


@query(PREPARED + " SELECT room, t, round(score, 6) AS score FROM curve")
def point_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The curve of the point scorer: EWMA, rolling z, median filter, lag, weights, change boost, decay."""
    _, curve = highlights.point_curve(A.signals(spark, sf).where(F.col("signal").isin(*DENSE)), "default", SETTINGS)
    return curve.select("room", "t", r6("score").alias("score"))


@query(POINTS)
def point_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The whole point scorer, from signals to titled clips, over those signals of events that are dense."""
    signals = A.signals(spark, sf).where(F.col("signal").isin(*DENSE))
    z, curve = highlights.point_curve(signals, "default", SETTINGS)
    good = highlights.intervals.quality(highlights.point_candidates(curve, z, SETTINGS), curve, SETTINGS)
    rows = highlights.point_clips(good, z, SETTINGS).join(good.select("room", "id", F.col("score").alias("exact")), ["room", "id"])
    return rows.select("room", "id", "start", "end", r6("exact").alias("score"), r6("p").alias("p"), "trigger", "title", F.array_join("tags", ",").alias("tags"), "thumbnail")
