"""SQL twins of greedy steps, as recursive queries: peaks by distance, merging of anchors, candidates of the first stage."""

from __future__ import annotations

from tidepeak.plans.queries_curves import STEP


def anchor_sql(min_gap: int, per_hour: float, n: int = 720) -> str:
    """CTEs up to merged (room, centre, place, t, anchor, score): each anchor with the chosen one that it belongs to, place being its turn."""
    cap = max(1, -(-int(per_hour * 1000 * n) // (3600 * 1000)))
    far = f"CASE WHEN o.sig = '' THEN {max(1, round(min_gap))} ELSE {max(1, round(min_gap / 2))} END"
    return STEP.replace("WITH ev", "WITH RECURSIVE ev", 1) + f""", rc AS (
  SELECT room, t, round(sum(w * value) + 0.2::DOUBLE * tanh(sum(w * greatest(d, 0))), 9) AS score FROM d JOIN weights USING (signal) GROUP BY room, t
), series AS (
  SELECT room, '' AS sig, t, score AS v FROM rc UNION ALL SELECT room, signal, t, value FROM z WHERE signal IN ('rms', 'dmDensity', 'eventLaughter')
), steps AS (
  SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY room, sig ORDER BY t) THEN 1 ELSE 0 END AS new FROM series
), flats AS (
  SELECT room, sig, min(t) AS a, max(t) AS b, any_value(v) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY room, sig ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM steps) GROUP BY room, sig, run
), tops AS (
  SELECT room, sig, (a + b) // 2 AS t, v FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM flats WINDOW w AS (PARTITION BY room, sig ORDER BY a)) WHERE v > l AND v > r AND (sig = '' OR v >= 1)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY room, sig ORDER BY v DESC, t DESC) AS i FROM tops
), thin AS (
  SELECT room, sig, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT room, sig FROM o)
  UNION ALL SELECT o.room, o.sig, o.i, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - o.t) < {far})) = 0 THEN list_append(r.kept, o.t::BIGINT) ELSE r.kept END FROM thin r JOIN o ON o.room = r.room AND o.sig = r.sig AND o.i = r.i + 1
), spaced AS (
  SELECT room, sig, unnest(kept)::INTEGER AS t FROM (SELECT room, sig, arg_max(kept, i) AS kept FROM thin GROUP BY room, sig)
), sides AS (
  SELECT s.room, s.t, c.score, coalesce((SELECT max(x.t) FROM rc x WHERE x.room = s.room AND x.t < s.t AND x.score > c.score), -1) AS l, coalesce((SELECT min(x.t) FROM rc x WHERE x.room = s.room AND x.t > s.t AND x.score > c.score), {n}) AS r
  FROM spaced s JOIN rc c ON c.room = s.room AND c.t = s.t WHERE s.sig = ''
), high AS (
  SELECT room, t FROM sides b WHERE score - greatest((SELECT min(x.score) FROM rc x WHERE x.room = b.room AND x.t > b.l AND x.t <= b.t), (SELECT min(x.score) FROM rc x WHERE x.room = b.room AND x.t >= b.t AND x.t < b.r)) >= 0.8
), anchors AS (
  SELECT a.room, a.t, a.anchor, round(rc.score, 6) AS score FROM (SELECT room, t, 'recallCurve' AS anchor FROM high UNION ALL SELECT room, t, sig FROM spaced WHERE sig <> '') a JOIN rc ON rc.room = a.room AND rc.t = a.t
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, (anchor = 'recallCurve')::INTEGER, t, anchor) AS place FROM anchors
), pick AS (
  SELECT room, 0::BIGINT AS place, []::INTEGER[] AS chosen, NULL::INTEGER AS centre FROM (SELECT DISTINCT room FROM turns)
  UNION ALL SELECT t.room, t.place, CASE WHEN len(list_filter(p.chosen, lambda c: abs(c - t.t) < {min_gap})) = 0 AND len(p.chosen) < {cap} THEN list_append(p.chosen, t.t) ELSE p.chosen END,
    CASE WHEN len(list_filter(p.chosen, lambda c: abs(c - t.t) < {min_gap})) > 0 THEN list_filter(p.chosen, lambda c: abs(c - t.t) < {min_gap})[1] WHEN len(p.chosen) < {cap} THEN t.t END
  FROM pick p JOIN turns t ON t.room = p.room AND t.place = p.place + 1
), merged AS (
  SELECT p.room, p.centre, p.place, t.t, t.anchor, t.score FROM pick p JOIN turns t ON t.room = p.room AND t.place = p.place WHERE p.centre IS NOT NULL
)"""


ANCHOR_MERGE = anchor_sql(6, 60.0) + """
SELECT room, centre AS t, max(score) AS score, string_agg(DISTINCT anchor, ',' ORDER BY anchor) AS anchors, string_agg(t::VARCHAR, ',' ORDER BY place) AS places FROM merged GROUP BY room, centre"""

RECALL = anchor_sql(6, 150.0) + """, near AS (
  SELECT DISTINCT m.room, m.centre, m.place, z.signal FROM merged m JOIN z ON z.room = m.room AND z.t BETWEEN m.t - 1 AND m.t + 1 JOIN weights USING (signal) WHERE z.value >= 1
), named AS (
  SELECT room, centre, anchor AS name, 0 AS place FROM merged WHERE anchor <> 'recallCurve' UNION ALL SELECT room, centre, signal, place FROM near
), firsts AS (
  SELECT room, centre, name, min(place) AS place FROM named GROUP BY room, centre, name
), sources AS (
  SELECT room, centre, string_agg(name, ',' ORDER BY place, name) AS sources FROM firsts GROUP BY room, centre
), c AS (
  SELECT room, centre, max(score) AS score, greatest(0, least(centre - 6, 708))::DOUBLE AS s FROM merged GROUP BY room, centre
)
SELECT c.room, row_number() OVER (PARTITION BY c.room ORDER BY s)::INTEGER AS id, s AS "start", s + 12 AS "end", score, coalesce(sources, 'recallCurve') AS sources FROM c LEFT JOIN sources USING (room, centre)"""
