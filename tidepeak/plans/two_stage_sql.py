"""SQL twin of the whole two-stage scorer: recall, fits, edges, features, scores, suppression and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.config import TwoStage
from tidepeak.plans import adapters as A
from tidepeak.plans import highlights
from tidepeak.plans.catalogue import RANGES, query
from tidepeak.plans.queries_intervals import EDGE, EDGES
from tidepeak.plans.recursive_sql import RECALL

SETTINGS = TwoStage(per_hour=150.0, min_gap=6.0, window=12.0)
EDGE8 = EDGE.replace("- 4)", "- 8)").replace("+ 4)", "+ 8)").replace("/ 4 - weight", "/ 8 - weight")


def bounds(kind: str) -> str:
    """The range of a content type within 5 to 24 seconds; only two types can come of these signals."""
    return f"CASE {kind} WHEN 'funny' THEN 12 ELSE 15 END::DOUBLE AS lo, 24::DOUBLE AS hi"


def fit(name: str, source: str) -> str:
    """Windows (room, id, s, e, lo, hi, ...) of a CTE fitted and moved, with changed."""
    return f""", {name}_0 AS (SELECT *, greatest(1, least(720, round_even(least(greatest(greatest(0, e - s), lo), hi), 0)::INTEGER)) AS size FROM {source}
), {name}_1 AS (SELECT *, least(greatest(0, round_even(s, 0)::INTEGER), 720 - size) AS base FROM {name}_0
), {name}_2 AS (SELECT room, id, size, base, unnest(range(greatest(0, base - 8)::BIGINT, least(720 - size, base + 8)::BIGINT + 1)) AS pos FROM {name}_1
), {name}_3 AS (SELECT x.room, x.id, arg_max(pos, [round(b.u - a.u, 9), -abs(pos - base), -pos]) AS spot FROM {name}_2 x JOIN pre a ON a.room = x.room AND a.t = pos JOIN pre b ON b.room = x.room AND b.t = pos + size GROUP BY x.room, x.id
), {name} AS (SELECT x.* EXCLUDE (s, e, size, base), spot::DOUBLE AS s, (spot + size)::DOUBLE AS e, size <> round_even(greatest(0, e - s), 0) OR abs(spot - s) > 0.05 AS changed FROM {name}_1 x JOIN {name}_3 USING (room, id))"""


def features(name: str, source: str) -> str:
    """Statistics of each weighted signal in windows, and the names of the active ones by falling contribution."""
    inside, before, after = "z.t >= w.s AND z.t < w.e", "z.t < w.s", "z.t >= w.e"
    return f""", {name} AS (SELECT f.*, weights.w, peak >= 1 OR (mean >= 0.5 AND peak > 0.1) AS active FROM (
  SELECT w.room, w.id, any_value(w.s) AS s, any_value(w.e) AS e, signal, coalesce(max(value) FILTER ({inside}), 0) AS peak, coalesce(avg(value) FILTER ({inside}), 0) AS mean, coalesce(avg(value) FILTER ({before}), 0) AS pre, coalesce(avg(value) FILTER ({after}), 0) AS post
  FROM {source} w JOIN z ON z.room = w.room AND z.t >= w.s - (w.e - w.s) AND z.t < w.e + (w.e - w.s) GROUP BY w.room, w.id, signal) f JOIN weights USING (signal)
), {name}_on AS (SELECT room, id, coalesce(list(signal ORDER BY -round(w * mean, 6), signal) FILTER (active), []) AS active FROM {name} GROUP BY room, id)"""


def edges(prefix: str, column: str, source: str) -> str:
    """Places that an edge may move to, with the edge itself where none is close to it."""
    return EDGE8.format(p=prefix, c=column, x=source) + f""", {prefix}k AS (
  SELECT room, id, time, source, cost, rank FROM {prefix}r UNION ALL SELECT e.room, e.id, round_even(edge, 0), 'original', round(abs(round_even(edge, 0) - edge) / 8 - 0.2, 9), 11
  FROM {prefix}e e WHERE NOT EXISTS (SELECT 1 FROM {prefix}r r WHERE r.room = e.room AND r.id = e.id AND abs(r.time - e.edge) < 0.5))"""


TAIL = RECALL[: RECALL.index("\nSELECT c.room, row_number()")] + """, names AS (
  SELECT room, centre, list(name ORDER BY place, name) AS sources FROM firsts GROUP BY room, centre
), found AS (
  SELECT c.room, row_number() OVER (PARTITION BY c.room ORDER BY s) AS id, s, s + 12 AS e, coalesce(names.sources, ['recallCurve']) AS sources FROM c LEFT JOIN names USING (room, centre)
), pre AS (
  SELECT room, 0 AS t, 0.0::DOUBLE AS u FROM (SELECT DISTINCT room FROM curve) UNION ALL SELECT room, t + 1, sum(score) OVER (PARTITION BY room ORDER BY t) FROM curve
), prel AS (
  SELECT room, list(u ORDER BY t) AS us FROM pre GROUP BY room
), typed0 AS (
  SELECT *, """ + bounds("CASE WHEN list_contains(sources, 'eventLaughter') THEN 'funny' ELSE 'default' END") + """ FROM found
)""" + fit("first", "typed0") + features("ff", "first") + """, typed AS (
  SELECT x.room, x.id, x.s, x.e, sources, changed AS refit, kind, """ + bounds("kind") + """ FROM (SELECT first.*, CASE WHEN list_contains(sources, 'eventLaughter') OR list_contains(active, 'eventLaughter') THEN 'funny' ELSE 'default' END AS kind FROM first JOIN ff_on USING (room, id)) x
)""" + fit("second", "typed") + EDGES[len(RANGES) :] + edges("a", "s", "second") + edges("b", "e", "second") + """, duo AS (
  SELECT a.room, a.id, a.time AS x, b.time AS y, a.source AS sx, b.source AS sy, a.cost + b.cost AS c, a.rank AS ra, b.rank AS rb FROM ak a JOIN bk b USING (room, id) WHERE b.time - a.time >= 1
), priced AS (
  SELECT p.*, round(c + CASE WHEN y - x < lo THEN 1 + 2 * (lo - (y - x)) / greatest(lo, 1) WHEN y - x > hi THEN 1 + 2 * (y - x - hi) / greatest(hi, 1) ELSE 0 END + greatest(0, was - (us[y::INTEGER + 1] - us[x::INTEGER + 1])) / greatest(abs(was), 1) * 0.3::DOUBLE, 8) AS total
  FROM (SELECT d.*, lo, hi, us, us[w.e::INTEGER + 1] - us[w.s::INTEGER + 1] AS was FROM duo d JOIN second w ON w.room = d.room AND w.id = d.id JOIN prel ON prel.room = d.room) p
), cheap AS (
  SELECT room, id, x, y, sx, sy FROM (SELECT *, row_number() OVER (PARTITION BY room, id ORDER BY total, ra, rb) AS place FROM priced) WHERE place = 1
), moved AS (
  SELECT m.room, m.id, sources, refit, kind, lo, hi, changed AS before, m.s AS edge_s, m.e AS edge_e, coalesce(x, m.s)::DOUBLE AS s, coalesce(y, m.e)::DOUBLE AS e, coalesce(sx, 'original') AS sx, coalesce(sy, 'original') AS sy,
    abs(coalesce(x, m.s) - m.s) >= 0.5 OR abs(coalesce(y, m.e) - m.e) >= 0.5 AS moved FROM second m LEFT JOIN cheap USING (room, id)
), misfit AS (
  SELECT * FROM moved WHERE moved AND NOT (e - s BETWEEN lo - 0.5 AND hi + 0.5)
)""" + fit("again", "misfit") + """, placed AS (
  SELECT room, id, sources, kind, lo, hi, refit OR before AS refit, s, e, sx, sy, moved, false AS fallback FROM moved WHERE NOT moved OR e - s BETWEEN lo - 0.5 AND hi + 0.5
  UNION ALL SELECT room, id, sources, kind, lo, hi, refit OR before OR far, CASE WHEN far THEN s ELSE edge_s END, CASE WHEN far THEN e ELSE edge_e END, 'original', 'original', false, far FROM (SELECT *, abs(s - edge_s) >= 0.5 OR abs(e - edge_e) >= 0.5 AS far FROM again)
)""" + features("fz", "placed") + """, g AS (
  SELECT room, id, any_value(s) AS s, any_value(e) AS e, sum(w * peak) AS ps, sum(w * mean) AS ms, sum(w * ((mean - pre) + (mean - post)) / 2) AS pp, sum(CASE WHEN active THEN w ELSE 0 END) AS ag, CASE WHEN any_value(s) > 0 THEN sqrt(avg(power(mean - pre, 2))) ELSE 0 END AS nov,
    least(0.45, coalesce(sum(CASE WHEN peak >= 1 THEN CASE signal WHEN 'eventLaughter' THEN 0.18::DOUBLE WHEN 'sceneChange' THEN 0.05::DOUBLE WHEN 'dmUniqueUsers' THEN 0.04::DOUBLE ELSE 0 END END), 0)) AS bonus FROM fz GROUP BY room, id
), sq AS (
  SELECT g.*, p.* EXCLUDE (room, id, s, e, sources), list_concat(p.sources, list_filter(o.active, lambda x: NOT list_contains(p.sources, x))) AS every, len(o.active) AS n_active, CASE WHEN g.e - g.s < lo THEN (g.e - g.s) / lo WHEN g.e - g.s > hi THEN hi / (g.e - g.s) ELSE 1 END AS fit
  FROM g JOIN placed p ON p.room = g.room AND p.id = g.id JOIN fz_on o ON o.room = g.room AND o.id = g.id
), bs AS (
  SELECT *, 0.28::DOUBLE * CASE WHEN ps > 0 THEN 1 - exp(-ps / 2) ELSE 0 END + 0.22::DOUBLE * CASE WHEN ms > 0 THEN 1 - exp(-ms / 1.5::DOUBLE) ELSE 0 END + 0.18::DOUBLE * CASE WHEN pp > 0 THEN 1 - exp(-pp) ELSE 0 END + 0.14::DOUBLE * ag + 0.08::DOUBLE * CASE WHEN nov > 0 THEN 1 - exp(-nov / 2) ELSE 0 END + 0.10::DOUBLE * fit AS base FROM sq
), scored AS (
  SELECT *, round(base + bonus, 4) AS score, round(least(1, greatest(0, 0.6::DOUBLE * base + 0.4::DOUBLE * (base + bonus))), 4) AS confidence, array_to_string(every[1:5], '+') AS trigger,
    array_to_string(list_filter([CASE WHEN ag < 0.3 THEN 'low_signal_agreement' END, CASE WHEN nov < 0.1 THEN 'low_novelty' END, CASE WHEN fit < 0.9 THEN 'duration_mismatch' END, CASE WHEN refit OR moved THEN 'window_adjusted' END, 'asr_missing', CASE WHEN n_active = 0 THEN 'no_active_signal' END, CASE WHEN fallback THEN 'boundary_fallback' END], lambda x: x IS NOT NULL), ',') AS risks FROM bs
), o2 AS (
  SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id) AS i FROM scored
), keep AS (
  SELECT room, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, NULL::BIGINT AS id, NULL::STRUCT(s DOUBLE, e DOUBLE) AS taken FROM (SELECT DISTINCT room FROM o2) UNION ALL
  SELECT room, i, CASE WHEN taken IS NULL THEN list_append(kept, {'s': s, 'e': e}) ELSE kept END, id, taken FROM (SELECT o.room, o.i, o.id, o.s, o.e, r.kept,
    list_filter(r.kept, lambda k: least(o.e - o.s, k.e - k.s) > 0 AND (least(o.e, k.e) - greatest(o.s, k.s)) / least(o.e - o.s, k.e - k.s) >= 0.6)[1] AS taken FROM keep r JOIN o2 o ON o.room = r.room AND o.i = r.i + 1)
), ranked AS (
  SELECT s.*, k.taken, row_number() OVER (PARTITION BY s.room, k.taken IS NULL ORDER BY score DESC, s.s, s.id) AS rank FROM scored s JOIN keep k ON k.room = s.room AND k.id = s.id WHERE k.i > 0
)"""
CLIPS = TAIL + """
SELECT room, row_number() OVER (PARTITION BY room ORDER BY s, e)::INTEGER AS id, s AS "start", e AS "end", score, confidence, kind AS content_type, sx AS start_source, sy AS end_source, trigger, risks,
  CASE WHEN contains(trigger, 'eventLaughter') THEN '😂 搞笑高能' WHEN contains(trigger, 'dmDensity') THEN '🔥 弹幕爆发' WHEN contains(trigger, 'rms') THEN '🔊 音量爆发' WHEN contains(trigger, 'sceneChange') THEN '🎬 场景切换' ELSE '📹 高光时刻' END || ' (' || s::INTEGER || 's)' AS title,
  coalesce(nullif(concat_ws(',', CASE WHEN contains(trigger, 'eventLaughter') THEN '搞笑' END, CASE WHEN contains(trigger, 'dmDensity') OR contains(trigger, 'dmUniqueUsers') THEN '互动' END, CASE WHEN contains(trigger, 'rms') THEN '音量' END, CASE WHEN contains(trigger, 'sceneChange') THEN '场景' END), ''), '高光') AS tags
FROM ranked WHERE taken IS NULL AND rank <= 20"""
DROPPED = TAIL + """
SELECT room, s AS "start", e AS "end", score, CASE WHEN taken IS NOT NULL THEN 'overlap' ELSE 'top_k_cut' END AS reason, taken.s AS kept_start, taken.e AS kept_end FROM ranked WHERE taken IS NOT NULL OR rank > 20"""


@query(CLIPS)
def two_stage_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The whole two-stage scorer, from signals to titled clips."""
    rows = highlights.two_stage(A.signals(spark, sf), low=5.0, high=24.0, settings=SETTINGS)
    names = ("room", "id", "start", "end", "score", "confidence", "content_type", "start_source", "end_source", "trigger")
    return rows.select(*names, F.array_join("risks", ",").alias("risks"), "title", F.array_join("tags", ",").alias("tags"))


@query(DROPPED)
def two_stage_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """What the second stage dropped, and why."""
    _, result = highlights.two_stage_tables(A.signals(spark, sf), low=5.0, high=24.0, settings=SETTINGS)
    return result.dropped.select("room", "start", "end", "score", "reason", "kept_start", "kept_end")
