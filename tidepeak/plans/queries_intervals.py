"""Queries over intervals: boundaries, windows, rerank, evaluation, whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.functions.settle import settle
from tidepeak.operators import detect, evaluate, intervals, normalize, rerank
from tidepeak.plans import adapters as A
from tidepeak.plans import highlights
from tidepeak.plans.catalogue import EV, RANGES, ROBUST, query, r6
from tidepeak.plans.queries_curves import HOURLY, MAXIMA, z_and_weights


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """z, weights, curve and numbered peak ranges."""
    z, w = z_and_weights(spark, sf)
    z = settle(z)  # several branches of each plan read z and the curve
    curve = settle(normalize.base_score(z, w))
    return z, w, curve, intervals.number(detect.peak_ranges(detect.hot_ticks(curve, 1.0, HOURLY), 3))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("room", "start", "end", r6("score").alias("score"))


OUT = " SELECT room, s AS \"start\", e AS \"end\", round(score, 6) AS score FROM {x}"
VALLEY = RANGES + """, rv AS (SELECT room, t, value, avg(value) OVER (PARTITION BY room ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM z WHERE signal = 'rms'), v AS (SELECT room, t FROM rv WHERE value < m),
bounds AS (SELECT r.room, r.id, greatest(0, coalesce((SELECT min(t) FROM v WHERE v.room = r.room AND t BETWEEN r.s - 10 AND r.s - 1), greatest(0, r.s - 5)))::DOUBLE AS s,
  least(720, coalesce((SELECT min(t) FROM v WHERE v.room = r.room AND t BETWEEN r.e AND r.e + 9), r.e + 5))::DOUBLE AS e, score FROM ranges r)"""
EXPAND = """, x0 AS (SELECT room, id, s, CASE WHEN e <= s THEN least(720, s + 1) ELSE e END AS e, score FROM ranges),
x1 AS (SELECT room, id, CASE WHEN e - s < 5 THEN greatest(0, least(round_even((s + e) / 2 - 2.5, 0), 715)) ELSE s END AS s0, s, e, score FROM x0),
x2 AS (SELECT room, id, s0 AS s, CASE WHEN e - s < 5 THEN s0 + 5 ELSE e END AS e, score FROM x1),
held AS (SELECT room, t, round(sum(score) OVER (PARTITION BY room ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), 9) AS h FROM curve),
cut AS (SELECT x.room, x.id, arg_max(t, [h, -t]) AS spot FROM x2 x JOIN held ON held.room = x.room AND t BETWEEN x.s AND x.e - 24 WHERE x.e - x.s > 24 GROUP BY x.room, x.id),
fit AS (SELECT x.room, x.id, coalesce(spot::DOUBLE, s) AS s, coalesce(spot + 24::DOUBLE, e) AS e, score FROM x2 x LEFT JOIN cut USING (room, id))"""
MERGE = """, reach AS (SELECT *, max(e) OVER (PARTITION BY room ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fit),
island AS (SELECT *, sum(CASE WHEN s - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY room ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT room, min(s) AS s, max(e) AS e, max(score) AS score FROM island GROUP BY room, island),
mcut AS (SELECT m.room, m.s, arg_max(t, [h, -t]) AS spot FROM merged m JOIN held ON held.room = m.room AND t BETWEEN m.s AND m.e - 24 WHERE m.e - m.s > 24 GROUP BY m.room, m.s),
final AS (SELECT m.room, coalesce(spot::DOUBLE, m.s) AS s, coalesce(spot + 24::DOUBLE, e) AS e, score FROM merged m LEFT JOIN mcut ON mcut.room = m.room AND mcut.s = m.s)"""


@query(VALLEY + OUT.format(x="bounds"))
def valley_bounds(spark: SparkSession, sf: str) -> DataFrame:
    z, _, curve, ranges = parts(spark, sf)
    return shown(intervals.valley_bounds(ranges, z, intervals.sizes(curve)))


@query(RANGES + """, q AS (SELECT room, id, greatest(0, s - 20) AS s, least(720, e + 20) AS e, score FROM ranges), held AS (SELECT room, t, round(sum(score) OVER (PARTITION BY room ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 9) AS h FROM curve),
c AS (SELECT q.room, q.id, arg_max(t, [h, -t]) AS spot, any_value(q.score) AS score FROM q JOIN held ON held.room = q.room AND t BETWEEN q.s AND q.e - 10 GROUP BY q.room, q.id) SELECT room, spot::DOUBLE AS "start", spot + 10::DOUBLE AS "end", round(score, 6) AS score FROM c""")
def best_subwindow(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    wide = ranges.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - 20), "end": F.least(F.lit(720.0), F.col("end") + 20)})
    return shown(intervals.best_subwindow(wide, curve, 10.0))


@query(RANGES + EXPAND + OUT.format(x="fit"))
def expand(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    return shown(intervals.expand(ranges, curve, 5.0, 24.0))


@query(RANGES + EXPAND + MERGE + OUT.format(x="merged"))
def nms_merge(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    return shown(intervals.merge_near(intervals.expand(ranges, curve, 5.0, 24.0), 3.0))


@query(RANGES + EXPAND + MERGE + " SELECT room, round_even(s, 1)::DOUBLE AS \"start\", round_even(e, 1)::DOUBLE AS \"end\", 'duplicate' AS reason FROM reach WHERE s - reach < 3")
def nms_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    return intervals.merged_away(intervals.expand(ranges, curve, 5.0, 24.0), 3.0).drop("score")


TTEST = RANGES + EXPAND + """, st AS (SELECT w.room, w.id, any_value(w.s) AS s, any_value(w.e) AS e, any_value(w.score) AS score,
  count(c.score) FILTER (t >= w.s) AS n1, avg(c.score) FILTER (t >= w.s) AS m1, var_samp(c.score) FILTER (t >= w.s) AS v1, count(c.score) FILTER (t < w.s) AS n2, avg(c.score) FILTER (t < w.s) AS m2, var_samp(c.score) FILTER (t < w.s) AS v2
  FROM fit w JOIN curve c ON c.room = w.room AND t >= greatest(0, w.s - 5) AND t < w.e GROUP BY w.room, w.id),
tt AS (SELECT *, n1 + n2 - 2 AS nu, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1::DOUBLE + 1 / n2::DOUBLE)) AS tv FROM st WHERE n1 > 2 AND n2 > 2),
th AS (SELECT *, atan(abs(tv) / sqrt(nu)) AS a FROM tt),
pv AS (SELECT room, id, 1 - CASE WHEN nu % 2 = 0 THEN sin(a) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1)) / sqrt(pi()) * power(cos(a), 2 * k)))
  ELSE 2 / pi() * (a + CASE WHEN nu > 1 THEN sin(a) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5::DOUBLE)) * power(cos(a), 2 * k + 1))) ELSE 0 END) END AS p FROM th)"""


@query(TTEST + " SELECT room, s AS \"start\", e AS \"end\", round(CASE WHEN p > 0.05 THEN score * 0.7 ELSE score END, 6) AS score, round(p, 6) AS p FROM fit LEFT JOIN pv USING (room, id)")
def ttest_penalty(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    rows = intervals.penalise(intervals.expand(ranges, curve, 5.0, 24.0), curve)
    return rows.select("room", "start", "end", r6("score").alias("score"), r6("p").alias("p"))


STATS = RANGES + EXPAND + ", st AS (SELECT w.room, w.id, any_value(w.s) AS s, any_value(w.e) AS e, signal, any_value(ord) AS ord, max(value) AS peak, avg(value) AS mean FROM fit w JOIN z ON z.room = w.room AND t >= w.s AND t < w.e GROUP BY w.room, w.id, signal)"


@query(STATS + """, tr AS (SELECT w.room, w.id, w.s, coalesce(string_agg(signal, '+' ORDER BY ord), 'unknown') AS trigger FROM fit w LEFT JOIN (SELECT * FROM st WHERE peak > 2) st USING (room, id) GROUP BY w.room, w.id, w.s)
SELECT room, s AS "start", trigger, CASE WHEN contains(trigger, 'eventLaughter') THEN '😂 搞笑高能' WHEN contains(trigger, 'dmDensity') THEN '🔥 弹幕爆发' WHEN contains(trigger, 'rms') THEN '🔊 音量爆发' ELSE '📹 高光时刻' END || ' (' || s::INTEGER || 's)' AS title,
  array_to_string(CASE WHEN len(list_filter(x, lambda y: y <> '')) > 0 THEN list_filter(x, lambda y: y <> '') ELSE ['高光'] END, ',') AS tags
FROM (SELECT *, [CASE WHEN contains(trigger, 'eventLaughter') THEN '搞笑' ELSE '' END, CASE WHEN contains(trigger, 'dmDensity') THEN '互动' ELSE '' END, CASE WHEN contains(trigger, 'rms') THEN '音量' ELSE '' END, CASE WHEN contains(trigger, 'sceneChange') THEN '场景' ELSE '' END] AS x FROM tr)""")
def trigger_concat(spark: SparkSession, sf: str) -> DataFrame:
    z, _, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0)
    rows = wide.join(intervals.triggers(wide, z), ["room", "id"])
    return rows.select("room", "start", "trigger", intervals.title(F.col("trigger"), F.col("start")).alias("title"), F.array_join(intervals.tags(F.col("trigger")), ",").alias("tags"))


@query(STATS + ", b AS (SELECT room, id, s, signal, ord, round(w * mean, 4) AS c FROM st JOIN weights USING (signal)), r AS (SELECT *, row_number() OVER (PARTITION BY room, id ORDER BY abs(c) DESC, ord) AS rank FROM b) SELECT room, s AS \"start\", signal, c AS contribution FROM r WHERE rank <= 3")
def breakdown_topn(spark: SparkSession, sf: str) -> DataFrame:
    z, w, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0)
    return intervals.breakdown(wide, z, w, 3).join(wide.select("room", "id", "start"), ["room", "id"]).select("room", "start", "signal", "contribution")


WF = RANGES + EXPAND + """, f0 AS (SELECT w.room, w.id, any_value(w.s) AS s, any_value(w.e) AS e, signal, max(value) FILTER (t >= w.s AND t < w.e) AS peak, avg(value) FILTER (t >= w.s AND t < w.e) AS mean, sum(greatest(value, 0)) FILTER (t >= w.s AND t < w.e) AS area,
  coalesce(avg(value) FILTER (t < w.s), 0) AS pre, coalesce(avg(value) FILTER (t >= w.e), 0) AS post FROM fit w JOIN z ON z.room = w.room AND t >= w.s - (w.e - w.s) AND t < w.e + (w.e - w.s) GROUP BY w.room, w.id, signal),
f AS (SELECT f0.*, w.w, (peak >= 1 OR (mean >= 0.5 AND peak > 0.1)) AS active FROM f0 JOIN weights w USING (signal)),
g AS (SELECT room, id, any_value(s) AS s, any_value(e) AS e, sum(w * peak) AS ps, sum(w * mean) AS ms, sum(w * area / (e - s)) AS ars, sum(w * ((mean - pre) + (mean - post)) / 2) AS pp, sum(CASE WHEN active THEN w ELSE 0 END) AS ag,
  CASE WHEN any_value(s) > 0 THEN sqrt(avg(power(mean - pre, 2))) ELSE 0 END AS nov, least(0.45, coalesce(sum(CASE WHEN peak >= 1 THEN CASE signal WHEN 'eventLaughter' THEN 0.18::DOUBLE WHEN 'sceneChange' THEN 0.05::DOUBLE WHEN 'dmUniqueUsers' THEN 0.04::DOUBLE ELSE 0 END END), 0)) AS bonus FROM f GROUP BY room, id)"""


def featured(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    z, w, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0)
    signals = rerank.window_signals(wide, z, w)
    return wide, signals, rerank.window_totals(signals)


@query(WF + " SELECT room, s::INTEGER AS s, signal, round(peak, 6) AS peak, round(mean, 6) AS mean, round(area, 6) AS area, round(mean - pre, 6) AS pre_delta, round(mean - post, 6) AS post_delta, active FROM f")
def window_features(spark: SparkSession, sf: str) -> DataFrame:
    _, signals, _ = featured(spark, sf)
    return signals.select("room", "s", "signal", *[r6(c).alias(c) for c in ("peak", "mean", "area", "pre_delta", "post_delta")], "active")


@query(WF + " SELECT room, s::INTEGER AS s, round(ps, 6) AS peak_score, round(ms, 6) AS mean_score, round(ars, 6) AS area_score, round(pp, 6) AS pre_post_delta, round(ag, 6) AS agreement, round(nov, 6) AS novelty FROM g")
def window_novelty(spark: SparkSession, sf: str) -> DataFrame:
    totals = featured(spark, sf)[2]
    return totals.select("room", "s", *[r6(c).alias(c) for c in ("peak_score", "mean_score", "area_score", "pre_post_delta", "agreement", "novelty")])


SCORE = WF + """, sq AS (SELECT *, CASE WHEN e - s < 12 THEN (e - s) / 12 WHEN e - s > 20 THEN 20 / (e - s) ELSE 1 END AS fit FROM g),
bs AS (SELECT *, 0.28::DOUBLE * CASE WHEN ps > 0 THEN 1 - exp(-ps / 2) ELSE 0 END + 0.22::DOUBLE * CASE WHEN ms > 0 THEN 1 - exp(-ms / 1.5::DOUBLE) ELSE 0 END + 0.18::DOUBLE * CASE WHEN pp > 0 THEN 1 - exp(-pp) ELSE 0 END + 0.14::DOUBLE * ag + 0.08::DOUBLE * CASE WHEN nov > 0 THEN 1 - exp(-nov / 2) ELSE 0 END + 0.10::DOUBLE * fit AS base FROM sq)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    wide, signals, totals = featured(spark, sf)
    return rerank.window_score(totals.withColumns({"low": F.lit(12.0), "high": F.lit(20.0)}), signals)


@query(SCORE + " SELECT room, s::INTEGER AS s, round(base + bonus, 4) AS score, round(least(1, greatest(0, 0.6::DOUBLE * base + 0.4::DOUBLE * (base + bonus))), 4) AS confidence FROM bs")
def window_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("room", "s", "score", "confidence")


@query(SCORE + " SELECT room, s::INTEGER AS s, array_to_string(list_filter([CASE WHEN ag < 0.3 THEN 'low_signal_agreement' END, CASE WHEN nov < 0.1 THEN 'low_novelty' END, CASE WHEN fit < 0.9 THEN 'duration_mismatch' END, 'asr_missing', CASE WHEN ag = 0 THEN 'no_active_signal' END], lambda x: x IS NOT NULL), ',') AS risks FROM bs")
def risk_flags(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("room", "s", F.array_join(rerank.risks(F.lit(False), F.lit(False)), ",").alias("risks"))


@query(SCORE + ", r AS (SELECT room, id, s, round(base + bonus, 4) AS score FROM bs) SELECT room, s AS \"start\", score, rank FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id)::INTEGER AS rank FROM r) WHERE rank <= 10")
def topk_cut(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("room", "id", F.col("s").cast("double").alias("start"), "score")
    return rerank.top_k(rows, 10).select("room", "start", "score", "rank")


SELECTED = RANGES + EXPAND + """, t0 AS (SELECT room, id, s, least(720, round_even(least(greatest(e - s, 8), 20), 0))::INTEGER AS size FROM fit), t1 AS (SELECT *, least(greatest(0, round_even(s, 0)), 720 - size)::INTEGER AS base FROM t0),
t2 AS (SELECT t1.*, unnest(range(greatest(0, base - 8)::BIGINT, least(720 - size, base + 8)::BIGINT + 1)) AS pos FROM t1), t3 AS (SELECT t2.room, t2.id, t2.size, base, pos, round(sum(c.score), 8) AS held FROM t2 JOIN curve c ON c.room = t2.room AND c.t >= pos AND c.t < pos + size GROUP BY ALL),
sel AS (SELECT room, id, any_value(size) AS size, arg_max(pos, [held, -abs(pos - base), -pos]) AS spot FROM t3 GROUP BY room, id)"""


@query(SELECTED + " SELECT room, spot::DOUBLE AS \"start\", (spot + size)::DOUBLE AS \"end\" FROM sel")
def select_window(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0).withColumns({"low": F.lit(8.0), "high": F.lit(20.0)})
    return rerank.select_window(wide, curve).select("room", "start", "end")


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 1 THEN 'game' WHEN c_custkey % 3 = 0 THEN 'interaction' WHEN c_custkey % 5 = 0 THEN 'funny' WHEN c_custkey % 2 = 0 THEN 'talent' ELSE 'default' END AS kind FROM customer),
d AS (SELECT *, greatest(15, CASE kind WHEN 'game' THEN 15 WHEN 'interaction' THEN 30 WHEN 'funny' THEN 12 WHEN 'talent' THEN 45 ELSE 15 END)::DOUBLE AS lo, least(90, CASE kind WHEN 'game' THEN 60 WHEN 'interaction' THEN 90 WHEN 'funny' THEN 35 WHEN 'talent' THEN 120 ELSE 90 END)::DOUBLE AS hi FROM k)
SELECT c_custkey, kind, CASE WHEN greatest(lo, 60) <= least(hi, 180) THEN greatest(lo, 60) ELSE lo END AS low, CASE WHEN greatest(lo, 60) <= least(hi, 180) THEN least(hi, 180) ELSE hi END AS high FROM d""")
def duration_policy(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    names = F.filter(F.array(F.when(key % 3 == 0, F.lit("speakerChange")), F.when(key % 5 == 0, F.lit("eventLaughter")), F.when(key % 2 == 0, F.lit("eventMusic"))), lambda x: x.isNotNull())
    kind = rerank.content_type(F.when(key % 7 == 1, F.lit("game")).otherwise("default"), names)
    low, high = rerank.duration_range(F.col("kind"), 15.0, 90.0, "bilibili")
    return A.table(spark, sf, "customer").select("c_custkey", kind.alias("kind")).withColumn("low", low).withColumn("high", high)


def minima(x: str, name: str) -> str:
    """MAXIMA of a negated series under other names."""
    return MAXIMA.format(x=x).replace("runs AS", f"{name}_runs AS").replace("FROM runs", f"FROM {name}_runs").replace("flat AS", f"{name}_flat AS").replace("FROM flat", f"FROM {name}_flat").replace("peak AS", f"{name} AS")


EDGES = RANGES + ", nrms AS (SELECT room, t, -value AS score FROM z WHERE signal = 'rms'), nsc AS (SELECT room, t, value AS score FROM z WHERE signal = 'sceneChange'), ncv AS (SELECT room, t, -score AS score FROM curve)" + minima("nrms", "silence") + minima("nsc", "scene") + minima("ncv", "trough")
EDGE = """, {p}e AS (SELECT room, id, {c} AS edge, greatest(0, floor({c} - 4)) AS lo, least(720, ceil({c} + 4)) AS hi, greatest(greatest(0, floor({c} - 4)), least(719, least(720, ceil({c} + 4)))) AS last FROM {x}),
{p}c AS (SELECT room, id, edge, round_even(edge, 0) AS time, 'original' AS source, 0.2::DOUBLE AS weight FROM {p}e UNION ALL SELECT e.room, id, edge, t, 'silence', 0.9 FROM {p}e e JOIN silence s ON s.room = e.room AND t > lo AND t < last
  UNION ALL SELECT e.room, id, edge, t, 'sceneChange', 0.8 FROM {p}e e JOIN scene s ON s.room = e.room AND t > lo AND t < last AND s.score >= 0.5 UNION ALL SELECT e.room, id, edge, t, 'scoreValley', 0.7 FROM {p}e e JOIN trough s ON s.room = e.room AND t > lo AND t < last),
{p}b AS (SELECT *, round(abs(time - edge) / 4 - weight, 9) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY room, id, time ORDER BY weight DESC, source) AS one FROM {p}c) WHERE one = 1),
{p}r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room, id ORDER BY cost, time)::INTEGER AS rank FROM {p}b) WHERE rank <= 10)"""


@query(EDGES + EDGE.format(p="a", c="s", x="ranges") + " SELECT room, edge, time::DOUBLE AS time, source, cost, rank FROM ar")
def edge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    z, _, curve, ranges = parts(spark, sf)
    rows = rerank.edge_candidates(ranges.select("room", "id", F.col("start").alias("edge")), z, curve, None, 4.0)
    return rows.select("room", "edge", "time", "source", "cost", "rank")


@query(EDGES + EXPAND + EDGE.format(p="a", c="s", x="fit") + EDGE.format(p="b", c="e", x="fit") + """, pairs AS (SELECT a.room, a.id, a.time AS x, b.time AS y, a.source AS sx, b.source AS sy, a.cost + b.cost AS c, a.rank AS ra, b.rank AS rb FROM ar a JOIN br b USING (room, id) WHERE b.time - a.time >= 1),
pre AS (SELECT room, 0 AS t, 0.0::DOUBLE AS u FROM (SELECT DISTINCT room FROM curve) UNION ALL SELECT room, t + 1, sum(score) OVER (PARTITION BY room ORDER BY t) FROM curve),
tot AS (SELECT p.*, q1.u - q0.u AS held, w1.u - w0.u AS was FROM pairs p JOIN fit w USING (room, id) JOIN pre q0 ON q0.room = p.room AND q0.t = p.x JOIN pre q1 ON q1.room = p.room AND q1.t = p.y JOIN pre w0 ON w0.room = p.room AND w0.t = w.s JOIN pre w1 ON w1.room = p.room AND w1.t = w.e),
cst AS (SELECT *, round(c + CASE WHEN y - x < 5 THEN 1 + 2 * (5 - (y - x)) / 5 WHEN y - x > 24 THEN 1 + 2 * (y - x - 24) / 24 ELSE 0 END + greatest(0, was - held) / greatest(abs(was), 1) * 0.3::DOUBLE, 8) AS total FROM tot)
SELECT room, x::DOUBLE AS "start", y::DOUBLE AS "end", sx AS start_source, sy AS end_source FROM (SELECT *, row_number() OVER (PARTITION BY room, id ORDER BY total, ra, rb) AS place FROM cst) WHERE place = 1""")
def edge_search(spark: SparkSession, sf: str) -> DataFrame:
    z, _, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0).withColumns({"low": F.lit(5.0), "high": F.lit(24.0)})
    return rerank.search_edges(wide, z, curve, None, 4.0).select("room", "start", "end", "start_source", "end_source")


@query()
def suppress_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    return rerank.suppress_overlaps(intervals.expand(ranges, curve, 5.0, 24.0))


# ── evaluation ──
SESSIONS = """, {n}0 AS (SELECT user_id, value, k, line_no, (epoch_us(ts) / 1e6::DOUBLE - 1704067200) / 3600 AS h FROM ev WHERE {where}), {n}1 AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h, line_no) > 6 THEN 1 ELSE 0 END AS new FROM {n}0),
{n}2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY h, line_no ROWS UNBOUNDED PRECEDING) AS run FROM {n}1), {n} AS (SELECT user_id AS room, min(line_no) AS id, round(min(h), 6) AS s, round(max(h) + 0.5, 6) AS e, round(sum(value), 6) AS score, min(k) AS k FROM {n}2 GROUP BY user_id, run)"""
EVAL = EV + SESSIONS.format(n="c", where="true") + SESSIONS.format(n="p", where="type = 'purchase'") + """, rk AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id)::INTEGER AS rank FROM c), top AS (SELECT * FROM rk WHERE rank <= 10),
ann AS (SELECT room, id, s, e, 1 + k % 5 AS quality FROM p), pos AS (SELECT * FROM ann WHERE quality >= 3), neg AS (SELECT * FROM ann WHERE quality < 3),
pairs AS (SELECT t.room, t.id AS a_id, t.rank, q.id AS b_id, least(t.e, q.e) - greatest(t.s, q.s) AS o, (t.e - t.s) + (q.e - q.s) AS un FROM top t JOIN pos q ON q.room = t.room AND least(t.e, q.e) > greatest(t.s, q.s))"""


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    clips = A.intervals_of_users(spark, sf).select("room", "id", "start", "end", "score")
    notes = A.annotations(spark, sf)
    top = evaluate.ranked(clips).where("rank <= 10")
    return clips, top, notes.where(evaluate.is_positive()), notes.where(~evaluate.is_positive())


@query(EVAL + " SELECT room, a_id, b_id, round(o / (un - o), 6) AS iou FROM pairs")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, top, positives, _ = judged(spark, sf)
    return evaluate.match_edges(top, positives).select("room", "a_id", "b_id", r6("iou").alias("iou"))


@query(EV + SESSIONS.format(n="c", where="true") + """, w AS (SELECT room // 4 AS room, room * 1000000 + id AS id, s, e, score FROM c), rk AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id)::INTEGER AS rank FROM w),
d AS (SELECT a.room, a.id, a.rank, b.rank AS of, (least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) AS iou FROM rk a JOIN rk b ON b.room = a.room AND b.rank < a.rank AND least(a.e, b.e) > greatest(a.s, b.s))
SELECT room, id, rank, min(of) AS duplicate_of, round(arg_min(iou, of), 6) AS iou FROM d WHERE iou >= 0.2 GROUP BY ALL""")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    clips = A.intervals_of_users(spark, sf).select(F.expr("room DIV 4").alias("room"), (F.col("room") * 1000000 + F.col("id")).alias("id"), "start", "end", "score")
    return evaluate.duplicate_pairs(evaluate.ranked(clips), 0.2).select("room", "id", "rank", "duplicate_of", r6("iou").alias("iou"))


@query(EVAL + " SELECT n.room, n.id, string_agg(DISTINCT t.rank::VARCHAR, ',' ORDER BY t.rank::VARCHAR) AS ranks FROM neg n JOIN top t ON t.room = n.room AND least(t.e, n.e) > greatest(t.s, n.s) GROUP BY ALL")
def negative_hits(spark: SparkSession, sf: str) -> DataFrame:
    _, top, _, negatives = judged(spark, sf)
    return evaluate.negative_hits(top, negatives).select("room", "id", F.array_join(F.array_sort(F.col("ranks").cast("array<string>")), ",").alias("ranks"))


@query(EVAL + " SELECT t.room, t.id FROM top t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.room = t.room AND p.a_id = t.id)")
def unmatched_anti(spark: SparkSession, sf: str) -> DataFrame:
    _, top, positives, _ = judged(spark, sf)
    return evaluate.unmatched(top, evaluate.match_edges(top, positives)).select("room", "id")


@query()
def max_matching(spark: SparkSession, sf: str) -> DataFrame:
    _, top, positives, _ = judged(spark, sf)
    return evaluate.max_matching(evaluate.match_edges(top, positives))


@query()
def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    clips, *_ = judged(spark, sf)
    return evaluate.metrics(clips, A.annotations(spark, sf), 10)


MACRO = """WITH m AS (SELECT l_suppkey % 10 AS case_id, count(*) AS top, count(*) FILTER (l_returnflag = 'R') AS matched, count(*) FILTER (l_returnflag <> 'N') AS positives FROM lineitem GROUP BY ALL),
r AS (SELECT *, round(matched / top::DOUBLE, 4) AS p, round(matched / positives::DOUBLE, 4) AS q FROM m)
SELECT count(*) AS cases, round(avg(p), 4) AS macro_precision_at_k, round(avg(q), 4) AS macro_recall_at_k, round(sum(matched) / sum(top), 4)::DOUBLE AS micro_precision_at_k, round(sum(matched) / sum(positives), 4)::DOUBLE AS micro_recall_at_k FROM r"""


@query(MACRO)
def macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("case_id")).agg(
        F.count(F.lit(1)).alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("matched"), F.count_if(F.col("l_returnflag") != "N").alias("positives"),
    )
    p, r = F.col("matched") / F.col("top"), F.col("matched") / F.col("positives")
    full = rows.withColumns({"precision_at_k": F.round(p, 4), "recall_at_k": F.round(r, 4), "f1_at_k": F.lit(0.0), "mean_iou": F.lit(0.0), "invalid_rate": F.lit(0.0), "duplicate_rate": F.lit(0.0), "iou_sum": F.lit(0.0), "duplicates": F.lit(0)})
    return evaluate.aggregate(full).select("cases", "macro_precision_at_k", "macro_recall_at_k", "micro_precision_at_k", "micro_recall_at_k")


@query("""WITH v AS (SELECT 'precisionAtK' AS name, avg((quality = 1)::INTEGER) AS value FROM labels UNION ALL SELECT 'duplicateRate', avg((toxic = 1)::INTEGER) FROM labels UNION ALL SELECT 'meanIou', NULL)
SELECT name, round(value, 6) AS value, CASE name WHEN 'precisionAtK' THEN 0.6 WHEN 'duplicateRate' THEN 0.1 ELSE 0.5 END::DOUBLE AS target, CASE WHEN name = 'precisionAtK' THEN CASE WHEN value >= 0.6 THEN 'true' ELSE 'false' END WHEN name = 'duplicateRate' THEN CASE WHEN value <= 0.1 THEN 'true' ELSE 'false' END ELSE 'unknown' END AS met FROM v""")
def target_checks(spark: SparkSession, sf: str) -> DataFrame:
    rates = A.table(spark, sf, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("x"))
    values = rates.select(F.explode(F.create_map(F.lit("precisionAtK"), F.col("q"), F.lit("duplicateRate"), F.col("x"), F.lit("meanIou"), F.lit(None).cast("double"))).alias("name", "value"))
    return evaluate.target_checks(values).select("name", r6("value").alias("value"), "target", F.coalesce(F.col("met").cast("string"), F.lit("unknown")).alias("met"))


def profile_sql() -> str:
    from tidepeak.config import profile_rows

    return "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', {w!r}::DOUBLE)" for p, s, w in profile_rows()) + ") v(profile, signal, w))"


@query(profile_sql() + " SELECT a.profile AS \"left\", b.profile AS \"right\", round(sum(abs(a.w - b.w)) / 2, 6) AS total_variation, round(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))), 6) AS cosine FROM w a JOIN w b ON a.signal = b.signal AND a.profile < b.profile GROUP BY ALL")
def profile_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.profile_pairs(evaluate.profile_table(spark))
    return rows.select("left", "right", r6("total_variation").alias("total_variation"), r6("cosine").alias("cosine"))


@query("""WITH r AS (SELECT o_custkey AS label, o_orderpriority AS profile, round(avg(o_totalprice), 2) AS f, round(min(o_totalprice), 2) AS p FROM orders GROUP BY ALL)
SELECT label, arg_max(profile, {'f': f, 'p': p, 'own': (profile = '3-MEDIUM')::INTEGER, 'n': profile}) AS best FROM r GROUP BY label""")
def best_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("label"), F.col("o_orderpriority").alias("profile")).agg(F.round(F.avg("o_totalprice"), 2).alias("f1_at_k"), F.round(F.min("o_totalprice"), 2).alias("precision_at_k"))
    return evaluate.best_profile(rows.withColumn("own", F.lit("3-MEDIUM")))


@query("""WITH r AS (SELECT c_mktsegment AS profile, count(*) AS cases, count(*) FILTER (c_acctbal > 0) AS positives, round(avg(c_acctbal) / 100000, 6) AS delta FROM customer GROUP BY ALL),
k AS (SELECT profile, CASE WHEN cases < 2 OR positives < 5 THEN 'collect_more_or_merge' WHEN delta >= 0.045 THEN 'keep' ELSE 'merge_into_default' END AS recommendation FROM r) SELECT recommendation, string_agg(profile, ',' ORDER BY profile) AS profiles FROM k GROUP BY ALL""")
def profile_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("profile")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("c_acctbal") > 0).alias("positives"), F.round(F.avg("c_acctbal") / 100000, 6).alias("delta"))
    return evaluate.by_recommendation(evaluate.recommend(rows, min_delta=0.045))


@query(ROBUST + " SELECT 0 AS candidate, room, t, round(sum(value * CASE signal WHEN 'rms' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 6) AS score FROM z WHERE signal IN ('rms', 'dmDensity') GROUP BY room, t UNION ALL SELECT 1, room, t, round(value, 6) FROM z WHERE signal = 'rms'")
def candidate_weights(spark: SparkSession, sf: str) -> DataFrame:
    z, _ = z_and_weights(spark, sf)
    return evaluate.candidate_scores(z, [{"rms": 0.7, "dmDensity": 0.3}, {"rms": 1.0}]).withColumn("score", r6("score"))


@query()
def existing_matches(spark: SparkSession, sf: str) -> DataFrame:
    clips, _, positives, _ = judged(spark, sf)
    return evaluate.best_existing_match(clips, positives, 0.3).withColumn("iou", r6("iou"))


# ── whole plans ──
@query(RANGES + EXPAND + MERGE + ", r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s)::INTEGER AS rank FROM final) SELECT room, s AS \"start\", e AS \"end\", round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def highlights_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    z, w = z_and_weights(spark, sf)
    rows = highlights.from_curve(normalize.base_score(z, w), 1.0, HOURLY)
    return rows.select("room", "start", "end", r6("score").alias("score"), "rank")


@query()
def point_scorer(spark: SparkSession, sf: str) -> DataFrame:
    return highlights.point_scores(A.signals(spark, sf), settings=Scoring(sensitivity=1.0, persistence=2, min_duration=5.0, max_duration=24.0, merge_distance=3.0))


@query()
def two_stage_scorer(spark: SparkSession, sf: str) -> DataFrame:
    return highlights.two_stage(A.signals(spark, sf), low=5.0, high=24.0, settings=TwoStage(per_hour=150.0, min_gap=6.0, window=12.0))


@query()
def recall_candidates(spark: SparkSession, sf: str) -> DataFrame:
    z, w = z_and_weights(spark, sf)
    rows = detect.recall(normalize.recall_curve(z, w), z, w, 5.0, 24.0, TwoStage(per_hour=150.0, min_gap=6.0, window=12.0))
    return rows.select("room", "id", "start", "end", r6("score").alias("score"), F.array_join("sources", ",").alias("sources"))
