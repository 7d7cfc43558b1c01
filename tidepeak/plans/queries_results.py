"""Queries of result tables, reports, media and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepeak.config import Scoring
from tidepeak.operators import evaluate, intervals, manifest, media, report, rerank, timeline
from tidepeak.plans import adapters as A
from tidepeak.plans.catalogue import EV, RANGES, query, r6
from tidepeak.plans.queries_intervals import EVAL, EXPAND, SESSIONS, TTEST, WF, featured, parts, profile_sql
from tidepeak.sources import chat as chat_source
from tidepeak.streaming import live

JUDGED = (
    RANGES
    + """, q0 AS (SELECT room, id, score, CASE WHEN id % 3 = 0 THEN s ELSE greatest(0, s - CASE WHEN id % 3 = 1 THEN 20 ELSE 0 END) END AS s, CASE WHEN id % 3 = 0 THEN s WHEN id % 3 = 1 THEN least(720, e + 20) ELSE e END AS e FROM ranges),
held AS (SELECT room, t, round(sum(score) OVER (PARTITION BY room ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), 9) AS h FROM curve),
cut AS (SELECT x.room, x.id, arg_max(t, [h, -t]) AS spot FROM q0 x JOIN held ON held.room = x.room AND t BETWEEN x.s AND x.e - 24 WHERE x.e - x.s > 24 GROUP BY x.room, x.id),
q1 AS (SELECT x.room, x.id, x.s AS from_start, x.e AS from_end, coalesce(spot::DOUBLE, s) AS s, coalesce(spot + 24::DOUBLE, e) AS e, score FROM q0 x LEFT JOIN cut USING (room, id)),
q2 AS (SELECT *, CASE WHEN e - s < 5 THEN greatest(0, least(round_even((s + e) / 2 - 2.5, 0), 715)) ELSE s END AS s1 FROM q1),
fit AS (SELECT room, id, from_start, from_end, s1 AS s, CASE WHEN e - s < 5 THEN s1 + 5 ELSE e END AS e, score FROM q2)"""
    + TTEST[len(RANGES + EXPAND) :]
)


@query(JUDGED + """ SELECT room, id, from_start, from_end, s AS "start", e AS "end", round(CASE WHEN from_end > from_start AND p > 0.05 THEN score * 0.7 ELSE score END, 6) AS score,
  concat_ws(',', CASE WHEN from_end <= from_start THEN 'too_short' END, CASE WHEN from_end - from_start > 24 THEN 'trimmed_too_long' END, CASE WHEN from_end > from_start AND p > 0.05 THEN 't_test_insignificant' END) AS reasons
  FROM fit LEFT JOIN pv USING (room, id)""")
def quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    _, _, curve, ranges = parts(spark, sf)
    kind = F.col("id") % 3
    start = F.when(kind == 0, F.col("start")).otherwise(F.greatest(F.lit(0.0), F.col("start") - F.when(kind == 1, 20.0).otherwise(0.0)))
    end = F.when(kind == 0, F.col("start")).when(kind == 1, F.least(F.lit(720.0), F.col("end") + 20)).otherwise(F.col("end"))
    rows = intervals.judged(ranges.withColumns({"start": start, "end": end}), curve, Scoring(min_duration=5.0, max_duration=24.0))
    return rows.select("room", F.col("id").cast("long").alias("id"), "from_start", "from_end", "start", "end", r6("score").alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(WF + " SELECT room, s AS \"start\", signal, c AS contribution, rank FROM (SELECT room, s, signal, round(w * mean, 6) AS c, row_number() OVER (PARTITION BY room, id ORDER BY abs(round(w * mean, 6)) DESC, signal)::INTEGER AS rank FROM f WHERE w > 0) WHERE rank <= 2")
def window_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    wide, signals, _ = featured(spark, sf)
    return rerank.window_breakdown(signals, 2).join(wide.select("room", "id", "start"), ["room", "id"]).select("room", "start", "signal", "contribution", "rank")


USERS = EV + SESSIONS.format(n="c", where="true")


@query(USERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id)::INTEGER AS rank FROM c) SELECT room, id, s AS \"start\", e AS \"end\", score, rank, 'top_k_cut' AS reason FROM r WHERE rank > 3")
def topk_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.beyond_top_k(A.intervals_of_users(spark, sf).drop("k"), 3)


@query(USERS + """, r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id)::INTEGER AS place FROM c) SELECT room, id, place FROM r WHERE place <= 2""")
def best_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_candidates(A.intervals_of_users(spark, sf), 2).select("room", "id", "place")


@query(USERS + """ SELECT room, id, round(s, 3) AS "start", round(e, 3) AS "end", round(e - s, 3) AS duration, round(score, 4) AS score, CASE WHEN k % 3 > 0 THEN round(k / 7::DOUBLE, 4) END AS confidence, CASE WHEN k % 2 = 0 THEN 'review' ELSE 'keep' END AS action FROM c""")
def clip_metadata(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    rows = A.intervals_of_users(spark, sf).withColumns({
        "duration": none.cast("double"), "confidence": F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.col("k") / 7), "trigger": F.lit("rms"), "tags": none.cast("array<string>"),
        "risks": F.when(F.col("k") % 2 == 0, F.array(F.lit("low_novelty"))),
    })
    return report.clip_metadata(rows).select("room", "id", "start", "end", "duration", "score", "confidence", "action")


@query(USERS + """, x AS (SELECT room, id, greatest(0, round(s, 1)) AS a, round(e, 1) - round(s, 1) AS d, k, CASE WHEN k % 2 = 0 THEN '''a b.mp4''' ELSE 'source.mp4' END AS src FROM c)
SELECT room, id, 'ffmpeg -hide_banner -ss ' || printf('%.3f', a) || ' -i ' || src || ' -t ' || printf('%.3f', greatest(0.1::DOUBLE, round(d, 1))) || ' -c copy -y highlight_' || printf('%02d', k) || '_' || a::BIGINT - CASE WHEN a::BIGINT > a THEN 1 ELSE 0 END || 's_rms+motion.mp4' AS command FROM x""")
def cut_commands(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.intervals_of_users(spark, sf)
    start, end = F.round("start", 1), F.round(F.round("start", 1) + F.round(F.round("end", 1) - F.round("start", 1), 1), 1)
    command = report.cut_command(F.when(F.col("k") % 2 == 0, F.lit("a b.mp4")), start, end, F.col("k"), F.lit("rms+motion"))
    return rows.select("room", "id", command.alias("command"))


@query("SELECT room, t, line_no, place FROM (SELECT conv_id AS room, turn::INTEGER AS t, turn AS line_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS place FROM conversations) WHERE place <= 3")
def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    return report.last_messages(A.talk(spark, sf), 3).select("room", "t", "line_no", "place")


CUE = "printf('%02d', floor({x})::INTEGER) || ',' || CASE WHEN {x} > floor({x}) THEN '500' ELSE '000' END"


@query(f"""WITH c AS (SELECT conv_id AS room, turn * 3.5::DOUBLE AS s, turn * 3.5::DOUBLE + 2 AS e, role FROM conversations),
k AS (SELECT room, row_number() OVER (PARTITION BY room ORDER BY s)::INTEGER AS number, greatest(0, s - 5) AS a, least(10, e - 5) AS b, role FROM c WHERE e >= 5 AND s <= 15)
SELECT room, md5(string_agg(number || chr(10) || '00:00:' || {CUE.format(x="a")} || ' --> 00:00:' || {CUE.format(x="b")} || chr(10) || role, chr(10) || chr(10) ORDER BY number)) AS srt FROM k GROUP BY room""")
def subtitle_texts(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("turn") * 3.5
    cues = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("room"), start.alias("start"), (start + 2).alias("end"), F.col("role").alias("text"))
    clips = cues.select("room").distinct().select("room", F.lit(1).alias("id"), F.lit(5.0).alias("start"), F.lit(15.0).alias("end"))
    return report.subtitle_text(report.clip_subtitles(cues, clips)).select("room", F.md5("srt").alias("srt"))


@query("""WITH d AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN c_acctbal END, greatest(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 2::DOUBLE END, 0), c_custkey / 4::DOUBLE - 3, 0)) AS seconds FROM customer)
SELECT c_custkey, round(seconds, 6) AS seconds, CASE WHEN seconds > 0 THEN ceil(seconds)::INTEGER END AS ticks FROM d""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    seconds = timeline.duration(F.when(key % 3 == 0, F.col("c_acctbal")), F.when(key % 2 == 0, key / 2), key / 4 - 3)
    return A.table(spark, sf, "customer").select("c_custkey", r6(seconds).alias("seconds"), timeline.target_length(seconds).alias("ticks"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 0 ELSE p_size * 1000 / 1001::DOUBLE END, 6)::DOUBLE AS rate, CASE WHEN p_size % 2 = 0 AND p_size % 7 = 0 THEN 'proxy' ELSE 'legacy' END AS mode, CASE WHEN p_size % 2 = 0 AND p_size % 7 > 0 THEN 'proxy_failed' ELSE '' END AS reason FROM part")
def frame_rates(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rate = F.when(size % 5 == 0, size.cast("string")).otherwise(F.concat((size * 1000).cast("string"), F.when(size % 3 == 0, "/0").otherwise("/1001")))
    mode = media.visual_mode(F.when(size % 2 == 0, "proxy").otherwise("legacy"), size % 7 == 0)
    return A.table(spark, sf, "part").select("p_partkey", r6(media.frame_rate(rate)).alias("rate"), mode.alias("m")).select("p_partkey", "rate", "m.mode", "m.reason")


MEAN = "list_sum(list_transform(range({a}, {b}), lambda i: {d})) / {n}::DOUBLE"
TURN = "least(abs(e[i] - b[i]), 180 - abs(e[i] - b[i]))"


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 90 * x::DOUBLE) AS e, list_transform(lag(embedding) OVER (PARTITION BY vec_id // 900 ORDER BY vec_id), lambda x: 90 * x::DOUBLE) AS b FROM embeddings) SELECT vec_id, round(("
       + MEAN.format(a=1, b=9, d=TURN, n=8) + " + " + MEAN.format(a=9, b=17, d="abs(e[i] - b[i])", n=8) + " + " + MEAN.format(a=17, b=33, d="abs(e[i] - b[i])", n=16) + ") / 3, 6) AS score FROM v WHERE b IS NOT NULL")
def scene_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of vectors as histograms of hue, saturation and value."""
    now = F.transform("embedding", lambda x: x.cast("double") * 90)
    rows = A.table(spark, sf, "embeddings").select("vec_id", now.alias("e"))
    rows = rows.withColumn("b", F.lag("e").over(Window.partitionBy(F.floor(F.col("vec_id") / 900)).orderBy("vec_id"))).where("b IS NOT NULL")
    cut = lambda c, a, n: F.slice(c, a, n)
    score = media.scene_score(cut("e", 1, 8), cut("b", 1, 8), cut("e", 9, 8), cut("b", 9, 8), cut("e", 17, 16), cut("b", 17, 16))
    return rows.select("vec_id", r6(score).alias("score"))


@query("SELECT c_custkey, 'a' AS k, c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT c_custkey, 'b', 'x=y z' FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer")
def cookie_pairs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("a="), F.col("c_custkey").cast("string"), F.lit("; b = x=y z; bad; é=1; name="), F.col("c_name"))
    return A.table(spark, sf, "customer").select("c_custkey", F.explode(chat_source.cookies(text)).alias("k", "v"))


@query("SELECT c_name AS name, c_custkey::VARCHAR AS value FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 5 > 0")
def cookie_files(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    line = F.concat_ws("\t", F.lit("host"), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.when(key % 5 > 0, "0"), "c_name", key.cast("string"))
    return chat_source.netscape_cookies(A.table(spark, sf, "customer").select(F.when(key % 4 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")))


@query("""WITH f AS (SELECT '/r' || p_size AS folder, '/r' || p_size || '/f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.FLV' ELSE '.txt' END AS path, p_partkey * 7919 % 10007 AS length FROM part)
SELECT folder, arg_max(path, {'l': length, 'p': path}) AS path FROM f WHERE path NOT LIKE '%.txt' GROUP BY folder""")
def media_files(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(".mp4"), F.lit(".FLV"), F.lit(".txt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/r"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), kind)
    files = A.table(spark, sf, "part").select(path.alias("path"), (F.col("p_partkey") * 7919 % 10007).alias("length"))
    return chat_source.largest_media(files).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))


@query("SELECT floor(epoch(ts) / 1800)::BIGINT * 1800 AS file_start, count(*) AS n, round(max(round((epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE, 3)), 3) AS last FROM events GROUP BY ALL")
def file_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("received", F.col("ts"))
    stamped = live.rotated(live.stamped(rows, F.timestamp_seconds(F.lit(A.START))))
    return stamped.groupBy(F.unix_seconds("file_start").alias("file_start")).agg(F.count(F.lit(1)).alias("n"), F.max("recv_sec").alias("last"))


@query("""SELECT conv_id AS room, CASE conv_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'failed' WHEN 3 THEN 'invalid' ELSE 'missing' END AS status, conv_id % 5 > 0 AS degraded,
  CASE WHEN conv_id % 5 = 0 THEN count(*) ELSE 0 END::INTEGER AS segments, CASE WHEN conv_id % 5 = 0 THEN max(turn) + 2 ELSE 0 END::DOUBLE AS duration, CASE WHEN conv_id % 5 = 2 THEN 'x' END AS error FROM conversations GROUP BY conv_id""")
def transcript_reports(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 2.0).alias("end"), F.lit("a").alias("text")))))
    kind = F.col("room") % 5
    docs = A.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("room")).agg(turns.alias("turns"))
    doc = F.when(kind == 0, F.col("turns")).when(kind == 1, '{"segments":[]}').when(kind == 2, '{"status":"failed","error":"x"}').when(kind == 3, "oops")
    return chat_source.transcript_report(docs.select("room", doc.alias("doc")))


@query("SELECT p_partkey AS idx, CASE WHEN p_size % 7 = 0 THEN 'missing' WHEN p_size < 10 THEN 'too_small' WHEN p_size % 3 = 0 THEN 'bad_header' WHEN p_size % 5 = 0 THEN 'no_duration' ELSE '' END AS quarantine FROM part")
def segment_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = A.table(spark, sf, "part").select(
        F.lit(1).alias("room"), F.col("p_partkey").alias("idx"), F.when(size % 7 > 0, (size * 1024 / 10).cast("long")).alias("size"), F.when(size % 5 > 0, 3.0).otherwise(0.0).alias("seconds"), F.when(size % 3 > 0, "FLV").otherwise("MP4").alias("header"),
    )
    return manifest.segment_report(rows).select("idx", F.coalesce("quarantine", F.lit("")).alias("quarantine"))


@query("SELECT c_custkey::VARCHAR AS artifact, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN c_custkey % 4 = 3 AND c_custkey % 3 = 0 THEN 'b' ELSE '' END AS misaligned FROM customer")
def feature_reports(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    three = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    none = F.array().cast("array<double>")
    features = F.when(key % 4 == 3, F.create_map(F.lit("a"), three, F.lit("b"), F.when(key % 3 == 0, F.array(F.lit(1.0))).otherwise(three))).when(key % 4 == 2, F.create_map(F.lit("a"), none))
    rows = A.table(spark, sf, "customer").select(key.cast("string").alias("artifact"), F.when(key % 4 == 2, 0.0).otherwise(3.0).alias("duration"), features.alias("features"), F.when(key % 4 > 0, "{}").alias("doc"))
    return manifest.feature_status(rows).select("artifact", "status", F.array_join("misaligned", ",").alias("misaligned"))


@query("SELECT o_orderkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' ELSE 'invalid' END AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def failed_steps(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "failed").when(p == "2-HIGH", "invalid").when(p == "3-MEDIUM", "empty").otherwise("ok")
    return manifest.failures(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), status.alias("status")))


@query("SELECT o_custkey % 3 = 0 AS hit, count(*) AS n FROM orders GROUP BY ALL")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.cache_stats(A.table(spark, sf, "orders").select((F.col("o_custkey") % 3 == 0).alias("hit")))


@query(EVAL + " SELECT room, count(*) FILTER (quality >= 3) AS positives, count(*) AS annotations FROM ann GROUP BY room")
def positive_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.positive_counts(A.annotations(spark, sf))


@query(profile_sql() + " SELECT profile AS variant, row_number() OVER (PARTITION BY profile ORDER BY w DESC, signal)::INTEGER AS place, signal, round(w, 6) AS w FROM w WHERE w > 0 QUALIFY place <= 5")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.top_features(evaluate.profile_table(spark).withColumnRenamed("profile", "variant"))


@query("""WITH r AS (SELECT l_suppkey % 10 AS room, 5 AS k, avg((l_returnflag = 'N')::INTEGER) AS p, avg((l_linestatus = 'F')::INTEGER) AS q, CASE WHEN l_suppkey % 10 > 2 THEN avg(l_tax) * 10 END AS i FROM lineitem GROUP BY 1, l_suppkey % 10 > 2, k),
v AS (SELECT room, 'precisionAtK' AS name, p >= 0.6 AS met FROM r UNION ALL SELECT room, 'recallAtK', q >= 0.7 FROM r UNION ALL SELECT room, 'meanIou', coalesce(i >= 0.5, false) FROM r UNION ALL SELECT room, 'invalidRate', 1 - p <= 0.2 FROM r)
SELECT room, string_agg(name, ',' ORDER BY name) AS missed FROM v WHERE NOT met GROUP BY room""")
def failed_cases(spark: SparkSession, sf: str) -> DataFrame:
    room = F.col("l_suppkey") % 10
    rows = A.table(spark, sf, "lineitem").groupBy(room.alias("room")).agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("precision_at_k"), F.avg((F.col("l_linestatus") == "F").cast("int")).alias("recall_at_k"), (F.avg("l_tax") * 10).alias("iou"))
    full = rows.select("room", F.lit(5).alias("k"), "precision_at_k", "recall_at_k", F.when(F.col("room") > 2, F.col("iou")).alias("mean_iou"), (1 - F.col("precision_at_k")).alias("invalid_rate"), F.lit(0.0).alias("duplicate_rate"))
    return evaluate.failed_cases(evaluate.case_checks(full)).drop("k")


OVERLAPS = RANGES.replace("WITH ev", "WITH RECURSIVE ev", 1) + EXPAND + """, o AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, s, id) AS i FROM fit),
rec AS (SELECT room, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, NULL::BIGINT AS id, NULL::STRUCT(s DOUBLE, e DOUBLE) AS taken FROM (SELECT DISTINCT room FROM o) UNION ALL
  SELECT room, i, CASE WHEN taken IS NULL THEN list_append(kept, {'s': s, 'e': e}) ELSE kept END, id, taken FROM (SELECT o.room, o.i, o.id, o.s, o.e, r.kept,
    list_filter(r.kept, lambda k: least(o.e - o.s, k.e - k.s) > 0 AND (least(o.e, k.e) - greatest(o.s, k.s)) / least(o.e - o.s, k.e - k.s) >= 0.6)[1] AS taken FROM rec r JOIN o ON o.room = r.room AND o.i = r.i + 1))
SELECT room, id::INTEGER AS id, taken IS NULL AS kept, taken.s AS kept_start, taken.e AS kept_end FROM rec WHERE i > 0"""
MATCHES = EVAL.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, x AS (SELECT t.room, t.id, t.rank, q.id AS b, (least(t.e, q.e) - greatest(t.s, q.s)) / ((t.e - t.s) + (q.e - q.s) - (least(t.e, q.e) - greatest(t.s, q.s))) AS iou FROM rk t JOIN pos q ON q.room = t.room AND least(t.e, q.e) > greatest(t.s, q.s)),
l AS (SELECT room, id, row_number() OVER (PARTITION BY room ORDER BY min(rank)) AS i, list({'b': b, 'iou': iou} ORDER BY iou DESC, b) AS found FROM x WHERE iou >= 0.3 GROUP BY room, id),
rec AS (SELECT room, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS id, NULL::STRUCT(b BIGINT, iou DOUBLE) AS pick FROM (SELECT DISTINCT room FROM l) UNION ALL
  SELECT room, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.b) END, id, pick FROM (SELECT l.room, l.i, l.id, r.used, list_filter(l.found, lambda c: NOT list_contains(r.used, c.b))[1] AS pick FROM rec r JOIN l ON l.room = r.room AND l.i = r.i + 1))
SELECT room, id, pick.b AS existing_id, round(pick.iou, 6) AS iou FROM rec WHERE pick IS NOT NULL"""
