"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "highlights_end_to_end"


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    from pyspark.sql import functions as F

    return F.round(c, 6)


#: SQL that the queries share: events by room and hour, a dense spine, five signals, robust z, weights, curves.
EV = """WITH ev AS (
  SELECT (user_id % 5)::BIGINT AS room, floor((epoch(ts) - 1704067200) / 3600)::INTEGER AS t, event_id AS line_no, user_id, event_type AS type, value, ts,
    (props->>'$.k')::INTEGER AS k,
    event_type || CASE WHEN (props->>'$.k')::INTEGER % 7 = 0 THEN '?' WHEN (props->>'$.k')::INTEGER % 5 = 0 THEN '!' WHEN (props->>'$.k')::INTEGER % 11 = 0 THEN '[x]' ELSE '' END AS content
  FROM events
), spine AS (
  SELECT room, t FROM (SELECT DISTINCT room FROM ev) CROSS JOIN (SELECT unnest(range(720))::INTEGER AS t)
)"""
SIG = (
    EV
    + """, per AS (
  SELECT room, t, avg(value) AS r, (count(*) FILTER (type = 'error'))::DOUBLE AS l, count(*)::DOUBLE AS d, count(DISTINCT user_id)::DOUBLE AS u, max((type = 'signup')::INTEGER)::DOUBLE AS s FROM ev GROUP BY room, t
), wide AS (
  SELECT room, t, coalesce(r, 0) AS r, coalesce(l, 0) AS l, coalesce(d, 0) AS d, coalesce(u, 0) AS u, coalesce(s, 0) AS s FROM spine LEFT JOIN per USING (room, t)
), sig AS (
  SELECT room, t, 'rms' AS signal, 0 AS ord, r AS value FROM wide UNION ALL SELECT room, t, 'eventLaughter', 4, l FROM wide UNION ALL SELECT room, t, 'dmDensity', 7, d FROM wide
  UNION ALL SELECT room, t, 'dmUniqueUsers', 11, u FROM wide UNION ALL SELECT room, t, 'sceneChange', 26, s FROM wide
)"""
)
WEIGHTS = """, raw AS (SELECT * FROM (VALUES ('rms', 0.10::DOUBLE), ('eventLaughter', 0.10::DOUBLE), ('dmDensity', 0.15::DOUBLE), ('dmUniqueUsers', 0.05::DOUBLE), ('sceneChange', 0.05::DOUBLE)) v(signal, x)),
weights AS (SELECT signal, x / (SELECT sum(x) FROM raw) AS w FROM raw)"""
ROBUST = (
    SIG
    + """, med AS (
  SELECT room, signal, median(value) AS m, stddev_pop(value) AS sd FROM sig GROUP BY room, signal
), mad AS (
  SELECT room, signal, median(abs(value - m)) AS d FROM sig JOIN med USING (room, signal) GROUP BY room, signal
), z AS (
  SELECT room, t, signal, ord, greatest(-5, least(5, CASE WHEN 1.4826 * d > 1e-9 THEN (value - m) / (1.4826::DOUBLE * d) WHEN sd > 1e-9 THEN (value - m) / sd ELSE 0 END)) AS value
  FROM sig JOIN med USING (room, signal) JOIN mad USING (room, signal)
)"""
    + WEIGHTS
    + """, curve AS (SELECT room, t, round(sum(w * value), 9) AS score FROM z JOIN weights USING (signal) GROUP BY room, t)"""
)
#: Ticks that are hot at k = 1 with a persistence of 2, and what follows from them.
HOT = (
    ROBUST
    + """, frames AS (
  SELECT a.room, a.t, f.w, avg(b.score) AS m, avg(b.score * b.score) AS q
  FROM curve a CROSS JOIN (SELECT w, unnest(range(-w, w)) AS o FROM (VALUES (3), (10), (30)) v(w)) f JOIN curve b ON b.room = a.room AND b.t = greatest(0, least(719, a.t + f.o))
  GROUP BY a.room, a.t, f.w
), nexts AS (
  SELECT room, t, score, lead(score) OVER (PARTITION BY room ORDER BY t) AS s1 FROM curve
), hot AS (
  SELECT room, t, any_value(score) AS score, bool_or(score > m + sqrt(greatest(q - m * m, 0)) + 1e-9 AND coalesce(s1 > m + sqrt(greatest(q - m * m, 0)) + 1e-9, false)) AS hot
  FROM nexts JOIN frames USING (room, t) GROUP BY room, t
)"""
)
RANGES = (
    HOT
    + """, steps AS (
  SELECT room, t, score, CASE WHEN t - lag(t) OVER (PARTITION BY room ORDER BY t) > 3 THEN 1 ELSE 0 END AS new FROM hot WHERE hot
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY room ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM steps
), ranges AS (
  SELECT room, row_number() OVER (PARTITION BY room ORDER BY min(t), max(t)) AS id, min(t)::DOUBLE AS s, max(t)::DOUBLE AS e, max(score) AS score FROM runs GROUP BY room, run
)"""
)


def load() -> None:
    """Imports the modules that register queries."""
    from tidepeak.plans import queries_curves, queries_intervals, queries_mechanisms, queries_results, queries_sources, queries_text, recursive_sql, scorer_sql, two_stage_sql  # noqa: F401

    # greedy choices as recursive queries
    ORACLE["suppress_overlaps"], ORACLE["existing_matches"] = queries_results.OVERLAPS, queries_results.MATCHES
    ORACLE["anchor_merge"], ORACLE["recall_candidates"] = recursive_sql.ANCHOR_MERGE, recursive_sql.RECALL


load()
