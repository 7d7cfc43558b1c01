"""Queries of what keeps state, runs in one pass, or walks: all text signals, metrics at many k, streams, rotation, payloads, cases, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.functions.settle import shared_path
from tidepeak.operators import evaluate, report, rotation, timeline
from tidepeak.plans import adapters as A
from tidepeak.plans import text_signals
from tidepeak.plans.catalogue import SIG, query, r6
from tidepeak.plans.queries_intervals import EVAL, SESSIONS, judged
from tidepeak.plans.queries_text import COVER, HIT, PHRASES, TALK
from tidepeak.sources import cases as case_source
from tidepeak.sources import pages as page_source
from tidepeak.sources import store
from tidepeak.streaming import diversity, ledger, live

# ── all text signals from one scan ──
TEXT_SETTINGS = text_signals.TextSettings(
    phrases=tuple(PHRASES), radius=1, utr_radius=2, positive=("the", "la"), negative=("der", "que"), keywords={"highEnergy": ("the", "der"), "funny": ("thing", "ment")},
)
EMOJI_SQL = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]|\[[^\[\]]{1,8}\]"
TEXT_SIGNALS = TALK + """, marked AS (
  SELECT room, t, user_id, regexp_matches(content, '[?\\x{FF1F}]') AS q, regexp_matches(content, '[!\\x{FF01}]') AS x, regexp_matches(content, '""" + EMOJI_SQL + """') AS e,
    contains(lower(content), 'the') OR contains(lower(content), 'der') AS k0, contains(lower(content), 'thing') OR contains(lower(content), 'ment') AS k1 FROM chat
), rates AS (
  SELECT s.room, s.t, coalesce(count(*) FILTER (q) / nullif(count(q), 0)::DOUBLE, 0) AS q, coalesce(count(*) FILTER (x) / nullif(count(q), 0)::DOUBLE, 0) AS x, coalesce(count(*) FILTER (e) / nullif(count(q), 0)::DOUBLE, 0) AS e,
    coalesce(count(*) FILTER (k0) / nullif(count(q), 0)::DOUBLE, 0) AS k0, coalesce(count(*) FILTER (k1) / nullif(count(q), 0)::DOUBLE, 0) AS k1
  FROM spine s LEFT JOIN marked m ON m.room = s.room AND m.t BETWEEN s.t - 1 AND s.t + 1 GROUP BY s.room, s.t
), spoken AS (
  SELECT s.room, s.t, bool_or(contains(lower(text), 'the') OR contains(lower(text), 'der')) AS s0, bool_or(contains(lower(text), 'thing') OR contains(lower(text), 'ment')) AS s1, bool_or(""" + HIT.format(c="text") + """ AND s.t < """ + COVER + """) AS hit
  FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < least(ceil(asr.e), 8) GROUP BY s.room, s.t
), turns AS (
  SELECT s.room, s.t, speaker, lag(speaker) OVER (PARTITION BY s.room, s.t ORDER BY seg_idx) AS before FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < """ + COVER + """
), changed AS (SELECT DISTINCT room, t FROM turns WHERE before <> speaker
), per AS (SELECT room, t, count(*) AS n, count(DISTINCT user_id) AS users FROM chat GROUP BY room, t
), utr AS (
  SELECT s.room, s.t, CASE WHEN count(item) = 0 THEN 1 ELSE count(DISTINCT item) / count(item)::DOUBLE END AS u FROM spine s LEFT JOIN tok ON tok.room = s.room AND tok.t BETWEEN s.t - 2 AND s.t + 2 GROUP BY s.room, s.t
), said AS (SELECT room, t, regexp_replace(lower(content), '\\s+', '', 'g') AS item FROM chat
), rep AS (
  SELECT s.room, s.t, CASE WHEN count(item) = 0 THEN 0 ELSE (count(item) - count(DISTINCT item)) / count(item)::DOUBLE END AS r FROM spine s LEFT JOIN said ON said.room = s.room AND said.t BETWEEN s.t - 1 AND s.t + 1 AND item <> '' GROUP BY s.room, s.t
), c AS (SELECT s.room, s.t, item, count(*) AS c FROM spine s JOIN tok ON tok.room = s.room AND tok.t BETWEEN s.t - 1 AND s.t + 1 GROUP BY ALL
), cr AS (SELECT *, sum(c) OVER (PARTITION BY room, t) AS total, row_number() OVER (PARTITION BY room, t ORDER BY c DESC, item) AS place FROM c
), h AS (SELECT room, t, -sum(c / total::DOUBLE * log2(c / total::DOUBLE)) AS h FROM cr WHERE place <= 50 GROUP BY room, t
), mood AS (SELECT room, t, sign(sum((item IN ('the', 'la'))::INTEGER) - sum((item IN ('der', 'que'))::INTEGER)) * 0.5::DOUBLE AS mood FROM tok GROUP BY room, t
), thr AS (SELECT room, CASE WHEN count(*) < 60 THEN 0.3 ELSE greatest(0.15, least(0.6, quantile_cont(u, 0.2))) END AS thr FROM utr JOIN per USING (room, t) WHERE u > 0 GROUP BY room
), d AS (
  SELECT s.room, s.t, coalesce(n, 0) * CASE WHEN u > 0 THEN least(1, u / coalesce(thr, 0.3)) ELSE 1 END AS d, u FROM spine s JOIN utr USING (room, t) LEFT JOIN per USING (room, t) LEFT JOIN thr USING (room)
), wide AS (
  SELECT d.room, d.t, d, coalesce(lead(d) OVER w - 2 * d + lag(d) OVER w, 0) AS a, coalesce(h, 0) AS h, coalesce(mood, 0) AS mood, coalesce(users, 0)::DOUBLE AS users, u, r, q, x, e,
    least(1, 0.6::DOUBLE * k0 + CASE WHEN s0 THEN 0.4::DOUBLE ELSE 0 END) AS k0, least(1, 0.6::DOUBLE * k1 + CASE WHEN s1 THEN 0.4::DOUBLE ELSE 0 END) AS k1, coalesce(hit, false)::INTEGER::DOUBLE AS hit, (changed.t IS NOT NULL)::INTEGER::DOUBLE AS turn
  FROM d JOIN rates USING (room, t) JOIN rep USING (room, t) LEFT JOIN h USING (room, t) LEFT JOIN mood USING (room, t) LEFT JOIN per USING (room, t) LEFT JOIN spoken USING (room, t) LEFT JOIN changed ON changed.room = d.room AND changed.t = d.t
  WINDOW w AS (PARTITION BY d.room ORDER BY d.t)
)
SELECT room, t, signal, ord, round(value, 6) AS value FROM (
  SELECT room, t, unnest(['dmDensity', 'dmAcceleration', 'dmEntropy', 'dmSentiment', 'dmUniqueUsers', 'dmUtr', 'dmRepeatRate', 'dmQuestionRate', 'dmExclamationRate', 'dmEmojiRate', 'keywordHighEnergy', 'keywordFunny', 'asrKeyword', 'speakerChange']) AS signal,
    unnest([7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 23, 25]) AS ord, unnest([d, a, h, mood, users, u, r, q, x, e, k0, k1, hit, turn]) AS value FROM wide)"""


@query(TEXT_SIGNALS)
def text_signals_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal of chat and transcripts of all conversations; chat is scanned once."""
    rows = text_signals.signals(A.talk(spark, sf), A.transcripts(spark, sf), A.TURNS, TEXT_SETTINGS)
    return rows.select("room", "t", "signal", "ord", r6("value").alias("value"))


@query("SELECT conv_id AS room, count(*) AS messages, count(*) FILTER (turn >= 5) AS skipped FROM conversations GROUP BY conv_id")
def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of each room, and those outside of a recording of five ticks, from the facts that the signals are made of."""
    return text_signals.counted(text_signals.facts(A.talk(spark, sf), 5, TEXT_SETTINGS))


# ── metrics at many k ──
KS = (1, 3, 10)
#: Sessions of one user do not overlap, nor do annotations: their overlaps are paths, on which taking the first free pair is a largest matching.
MATCHED = EVAL.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, ks AS (SELECT unnest([1, 3, 10]) AS at_k),
seq AS (SELECT at_k AS k, p.room, a_id, b_id, row_number() OVER (PARTITION BY at_k, p.room ORDER BY t.s, q.s) AS n FROM pairs p JOIN top t ON t.room = p.room AND t.id = p.a_id JOIN pos q ON q.room = p.room AND q.id = p.b_id JOIN ks ON p.rank <= at_k),
walk AS (
  SELECT k, room, n, a_id AS a, b_id AS b, 1 AS size FROM seq WHERE n = 1
  UNION ALL SELECT s.k, s.room, s.n, CASE WHEN s.a_id <> w.a AND s.b_id <> w.b THEN s.a_id ELSE w.a END, CASE WHEN s.a_id <> w.a AND s.b_id <> w.b THEN s.b_id ELSE w.b END, w.size + (s.a_id <> w.a AND s.b_id <> w.b)::INTEGER
  FROM walk w JOIN seq s ON s.k = w.k AND s.room = w.room AND s.n = w.n + 1
), sizes AS (SELECT k, room, max(size)::BIGINT AS matched FROM walk GROUP BY ALL)"""


@query(MATCHED + " SELECT k, room, matched AS size, matched AS clips, matched AS annotations FROM sizes")
def matching_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the matching of every k, and how many different clips and annotations are in it."""
    _, top, positives, _ = judged(spark, sf)
    pairs = evaluate.matchings(evaluate.match_edges(top, positives), KS)
    return pairs.groupBy("k", "room").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("a_id").alias("clips"), F.count_distinct("b_id").alias("annotations"))


@query(MATCHED + """, n AS (SELECT room, count(*) FILTER (quality >= 3) AS positives, count(*) FILTER (quality < 3) AS negatives FROM ann GROUP BY room), cl AS (SELECT room, count(*) AS clips FROM c GROUP BY room),
hit AS (SELECT n.room, n.id, min(t.rank) AS rank FROM neg n JOIN top t ON t.room = n.room AND least(t.e, n.e) > greatest(t.s, n.s) GROUP BY ALL),
x AS (SELECT n.room, at_k AS k, cl.clips, least(cl.clips, at_k) AS top, positives, negatives, coalesce(matched, 0) AS matched, (SELECT count(*) FROM hit WHERE hit.room = n.room AND hit.rank <= at_k) AS negative_hits
  FROM n CROSS JOIN ks JOIN cl ON cl.room = n.room LEFT JOIN sizes ON sizes.room = n.room AND sizes.k = at_k WHERE positives > 0)
SELECT room, k, clips, top, positives, negatives, matched, 0 AS duplicates, negative_hits, round(matched / top::DOUBLE, 4) AS precision_at_k, round(matched / k::DOUBLE, 4) AS strict_precision_at_k, round(matched / positives::DOUBLE, 4) AS recall_at_k,
  round(2 * (matched / top::DOUBLE) * (matched / positives::DOUBLE) / nullif(matched / top::DOUBLE + matched / positives::DOUBLE, 0), 4) AS f, round((top - matched) / top::DOUBLE, 4) AS invalid_rate, round(negative_hits / nullif(negatives, 0)::DOUBLE, 4) AS negative_hit_rate FROM x""")
def metrics_by_k(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every case at every k, from one ranking and one matching; f is null where nothing is matched."""
    clips, *_ = judged(spark, sf)
    rows = evaluate.metrics_at(clips, A.annotations(spark, sf), KS)
    names = ("room", "k", "clips", "top", "positives", "negatives", "matched", "duplicates", "negative_hits", "precision_at_k", "strict_precision_at_k", "recall_at_k", "invalid_rate", "negative_hit_rate")
    return rows.select(*names, F.when(F.col("matched") > 0, F.col("f1_at_k")).alias("f"))


# ── streams ──
def run_stream(stream: DataFrame, kind: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a stored table."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode(kind).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.read_events(spark, sf, "events.parquet")
    return rows.select((F.col("user_id") % 5).alias("room"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", (F.col("event_id") % 20).cast("string")).alias("content"))


@query("""WITH ev AS (SELECT (user_id % 5)::BIGINT AS room, floor((epoch_us(ts) / 1e6::DOUBLE - 1704067200) / 3600)::INTEGER AS t, event_type AS a, (event_id % 20)::VARCHAR AS b FROM events),
tok AS (SELECT room, t, a AS item FROM ev UNION ALL SELECT room, t, b FROM ev), last AS (SELECT floor((max(epoch_us(ts)) / 1e6::DOUBLE - 10 - 1704067200) / 3600)::INTEGER - 1 AS t FROM events),
spine AS (SELECT room, t FROM (SELECT DISTINCT room FROM ev) CROSS JOIN (SELECT unnest(range((SELECT t FROM last) - 4))::INTEGER AS t))
SELECT s.room, s.t, count(DISTINCT item) AS "distinct", count(*) AS n FROM spine s JOIN tok ON tok.room = s.room AND tok.t BETWEEN s.t - 5 AND s.t + 5 GROUP BY s.room, s.t""")
def stream_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Token diversity of events as a stream, by counts that ticks enter and leave; of ticks whose window the watermark has passed."""
    return run_stream(diversity.token_diversity(event_stream(spark, sf), 5, 3600.0, A.START))


@query("SELECT 1 AS runs, count(*) AS rows, 0 AS dropped, 0 AS failed FROM events")
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What the ledger has of a stream over events: read back from the events that it appended."""
    path = shared_path(spark, "ledger")
    book = ledger.watch(spark, path)
    try:
        stream = live.tumbling_counts(event_stream(spark, sf), "1 hour")
        query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        book.totals(query)
    finally:
        book.close()
    return ledger.life(ledger.read_events(spark, path)).select(F.col("runs").cast("int").alias("runs"), "rows", F.col("dropped").cast("int").alias("dropped"), F.col("failed").cast("int").alias("failed"))


@query("""SELECT '1.0' AS "schemaVersion", 'order.' || CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'open' END AS event, o_custkey::VARCHAR AS "roomId", 'load' AS step, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 10 END AS "elapsedMs", o_orderpriority AS priority FROM orders""")
def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as structured events: core fields, and extra ones beside them."""
    rows = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("roomId"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") * 10).alias("elapsedMs"), F.col("o_orderpriority").alias("priority")
    )
    event = F.concat(F.lit("order."), F.when(F.col("status") == "F", "ok").otherwise("open"))
    return ledger.event_rows(rows, event, step="load").select("schemaVersion", "event", "roomId", "step", "status", "elapsedMs", "priority")


# ── rotation ──
ROTATION = """WITH RECURSIVE ch AS (
  SELECT (user_id % 5)::BIGINT AS room, epoch_us(ts) AS us, 100 + event_id % 900 AS bytes, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, 100 + event_id % 900) - 1 AS idx FROM events
), p AS (SELECT *, sum(bytes) OVER (PARTITION BY room ORDER BY idx) AS upto FROM ch
), cut AS (
  SELECT room, 0 AS file, 0::BIGINT AS start FROM ch GROUP BY room
  UNION ALL
  SELECT c.room, c.file + 1, (SELECT min(n.idx) + 1 FROM p n WHERE n.room = c.room AND n.idx >= c.start AND (n.us - s.us >= 129600000000 OR n.upto - s.upto + s.bytes >= 60000))
  FROM cut c JOIN p s ON s.room = c.room AND s.idx = c.start
), good AS (SELECT room, file, start, coalesce(lead(start) OVER (PARTITION BY room ORDER BY file), 1000000000) AS after FROM cut JOIN (SELECT room, max(idx) AS last FROM ch GROUP BY room) USING (room) WHERE start <= last)
"""


@query(ROTATION + "SELECT room, file::INTEGER AS file, count(*) AS chunks, sum(bytes)::BIGINT AS bytes FROM good JOIN ch USING (room) WHERE idx >= start AND idx < after GROUP BY room, file")
def file_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks of files that end after 36 hours or 60 000 bytes."""
    rows = A.table(spark, sf, "events").select((F.col("user_id") % 5).alias("room"), F.col("ts").cast("timestamp").alias("ts"), (100 + F.col("event_id") % 900).alias("bytes"))
    return rotation.files(rows, 36 * 3600.0, 60_000).select("room", F.col("file").cast("int").alias("file"), "chunks", "bytes")


# ── payloads of any depth ──
@query("""WITH k AS (SELECT c_custkey AS id FROM customer), u AS (
  SELECT id, 'or4' AS quality, 'http://h.example/' || id || '_x.flv' AS url FROM k UNION ALL SELECT id, 'hd', 'http://h.example/' || id || '_hd.flv?a=1&b=2' FROM k
  UNION ALL SELECT id, 'sd', 'http://h.example/' || id || '.flv' FROM k WHERE id % 2 = 0 UNION ALL SELECT id, 'ld', 'http://h.example/ld' || id || '_sd.flv' FROM k WHERE id % 2 = 0)
SELECT * FROM u""")
def payload_stream_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Stream addresses of nested API documents, one for each customer; every third has a later address of the same quality under an earlier key."""
    i = F.col("c_custkey").cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = join('{"z":{"rooms":[{"stream":{"flv":{"FULL_HD1":"http:\\/\\/h.example\\/', i, '_x.flv","HD1":"http://h.example/', i, '_hd.flv?a=1\\u0026amp;b=2"}}}')
    deep = F.when(F.col("c_custkey") % 2 == 0, join(',{"more":[[{"deep":{"sd":"http://h.example/', i, '.flv"}}],{"SD2":"http://h.example/ld', i, '_sd.flv","note":"no address"}]}')).otherwise("")
    late = F.when(F.col("c_custkey") % 3 == 0, join(',"a":{"HD1":"http://h.example/late_hd.flv","list":["http://h.example/own_md.flv"]}')).otherwise("")
    docs = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(first, deep, F.lit("]}"), late, F.lit("}")).alias("doc"))
    return page_source.payload_urls(docs)


# ── cases in folders ──
CASES = """WITH r AS (SELECT user_id % 5 AS room, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL)
SELECT 'case' || room AS label, CASE WHEN room = 4 THEN 'a4' ELSE 't' || room END AS room_id, CASE room WHEN 1 THEN 'game' WHEN 2 THEN 'odd' ELSE 'default' END AS profile, CASE WHEN room = 4 THEN 7 ELSE n END::DOUBLE AS duration, CASE WHEN room = 4 THEN 0 ELSE 2 END AS clips,
  CASE room WHEN 2 THEN 'unknown profile' WHEN 3 THEN 'no features' WHEN 4 THEN 'no time table' END AS problem, CASE WHEN room = 3 THEN 'audio_features.json,visual_features.json' ELSE 'visual_features.json' END AS missing,
  CASE WHEN room < 2 THEN 1 ELSE 0 END AS notes, CASE WHEN room < 2 THEN n + clicks END AS signal_sum FROM r"""


@query(CASES)
def case_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of the five rooms of events, written as documents into a folder each and read back in one scan; the unusable ones with what is wrong."""
    root = shared_path(spark, "cases")
    per_room = A.events(spark, sf).groupBy("room").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "click").alias("clicks"))
    for r in per_room.collect():  # the rooms that adapters make of events: five
        docs = {
            case_source.TABLE: f'{{"roomId":"t{r.room}","duration":{r.n},"profile":"talent","clips":[{{"start":1,"end":2,"score":0.5}},{{"id":9,"start":3,"end":4}}]}}',
            case_source.NOTES: f'{{"roomId":"a{r.room}","duration":7,"profile":"{ {1: "game", 2: "odd"}.get(r.room, "default") }","annotations":[{{"start":1,"end":2}},{{"start":5,"end":3}}]}}',
            case_source.FEATURES["audio"]: f'{{"features":{{"rms":[{r.n},{r.clicks}],"zcr":[]}}}}', case_source.FEATURES["text"]: '{"features":null}',
        }
        gone = {3: case_source.FEATURES["audio"], 4: case_source.TABLE}.get(r.room)
        for name in docs.keys() - {gone}:
            store.write_document(spark, f"{root}/more/case{r.room}/{name}", docs[name])
    found = case_source.cases(case_source.read_files(spark, root))
    good, _ = case_source.annotations(found)
    notes = good.groupBy(F.col("room").alias("label")).agg(F.count(F.lit(1)).alias("notes"))
    sums = case_source.signals(found).groupBy(F.col("room").alias("label")).agg(F.sum("value").cast("long").alias("signal_sum"))
    rows = found.select("label", "room_id", "profile", "duration", F.size("clips").alias("clips"), "problem", F.array_join("missing", ",").alias("missing"))
    return rows.join(notes, "label", "left").join(sums, "label", "left").withColumn("notes", F.coalesce("notes", F.lit(0)).cast("int"))


# ── manifests ──
@query("""WITH p AS (SELECT s_suppkey AS k FROM supplier), d AS (SELECT k, CASE WHEN k % 7 = 0 AND k % 2 = 1 THEN 'metadata missing' WHEN k % 5 = 0 AND k % 2 = 1 THEN 'artifact modified' WHEN k % 11 = 0 THEN 'parameters changed' ELSE 'cache hit' END AS reason FROM p),
m AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'checked by hand' ELSE reason END AS reason FROM d) SELECT 's' || k AS artifact, reason = 'cache hit' AS hit, reason FROM m""")
def manifest_store(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as artifacts in a versioned manifest: recorded, partly invalidated, partly recorded again, then decided on, with misses of the caller's own."""
    kept = store.ManifestStore(spark, shared_path(spark, "manifest"))
    key = F.col("s_suppkey")
    rows = A.table(spark, sf, "supplier").select(
        key, F.concat(F.lit("s"), key).alias("artifact"), F.lit("score").alias("step"), F.lit("x").alias("settings"), F.lit("p").alias("params"), F.create_map(F.lit("in"), key.cast("string")).alias("sources"), F.lit("d1").alias("digest")
    )
    kept.record(rows)
    kept.invalidate(rows.where("s_suppkey % 7 = 0"))
    kept.record(rows.where("s_suppkey % 2 = 0"))
    digest, params = F.when((key % 5 == 0) & (key % 2 == 1), "d2").otherwise("d1"), F.when(key % 11 == 0, "q").otherwise("p")
    # a changed parameter is told before a changed file
    params = F.when((key % 5 == 0) & (key % 2 == 1), F.lit("p")).otherwise(params)
    decided = kept.reuse(rows.withColumns({"digest": digest, "params": params}))
    own = rows.where("s_suppkey % 13 = 0").select("artifact", F.lit("checked by hand").alias("reason"))
    return store.mark_miss(decided, own)


# ── what came out of every room ──
@query(SIG + SESSIONS.format(n="c", where="true") + """, x AS (SELECT room % 5 AS room, s, e, k FROM c), f AS (
  SELECT room, 'clip' AS kind, 'duration' AS name, e - s AS value FROM x UNION ALL SELECT room, 'dropped', CASE WHEN k % 2 = 0 THEN 'overlap' ELSE 'unknown' END, NULL FROM x WHERE k % 3 = 0 UNION ALL SELECT room, 'adjusted', 'trimmed', NULL FROM x WHERE k % 5 = 0
  UNION ALL SELECT room, 'signal', signal, max(t) + 1 FROM sig WHERE t < 700 GROUP BY room, signal UNION ALL SELECT room, 'aligned', CASE WHEN signal IN ('sceneChange', 'eventLaughter') THEN 'pad' ELSE 'stretch' END, NULL FROM sig GROUP BY room, signal)
SELECT CASE WHEN grouping(room) + grouping(name) = 2 THEN 'all' WHEN grouping(room) = 1 THEN 'name of all' WHEN grouping(name) = 1 THEN 'room' ELSE 'name' END AS level, room, kind, name, count(*) AS n, round(min(value), 3)::DOUBLE AS least, round(avg(value), 2)::DOUBLE AS mean, round(max(value), 3)::DOUBLE AS most
FROM f GROUP BY GROUPING SETS ((room, kind, name), (room, kind), (kind, name), (kind))""")
def room_baseline(spark: SparkSession, sf: str) -> DataFrame:
    clips = A.intervals_of_users(spark, sf).withColumn("room", F.col("room") % 5)
    dropped = clips.where("k % 3 = 0").select("room", F.when(F.col("k") % 2 == 0, "overlap").alias("reason"))
    adjusted = clips.where("k % 5 = 0").select("room", F.lit("trimmed").alias("reason"))
    short = A.signals(spark, sf).where("t < 700")
    rows = report.baseline(clips, dropped, adjusted, short, timeline.alignment_report(short, A.HOURS))
    return rows.select("level", "room", "kind", "name", "n", F.round("least", 3).alias("least"), F.round("mean", 2).alias("mean"), F.round("most", 3).alias("most"))
