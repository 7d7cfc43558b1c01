"""Queries over chat, transcripts, time lines and documents of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.operators import manifest, report, text, timeline
from tidepeak.plans import adapters as A
from tidepeak.plans.catalogue import EV, SIG, query, r6
from tidepeak.schema import order_of
from tidepeak.sources import chat as chat_source
from tidepeak.sources import pages as page_source

TALK = """WITH chat AS (
  SELECT conv_id AS room, turn::INTEGER AS t, turn AS line_no, role AS user_id, text AS content FROM conversations
), spine AS (
  SELECT room, t FROM (SELECT DISTINCT room FROM chat) CROSS JOIN (SELECT unnest(range(8))::INTEGER AS t)
), tok AS (
  SELECT room, t, item FROM (SELECT room, t, unnest(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) AS item FROM chat) WHERE item <> ''
), asr AS (
  SELECT conv_id AS room, turn::INTEGER AS seg_idx, turn::DOUBLE AS s, turn::DOUBLE + 2 AS e, text, role AS speaker FROM conversations
)"""
WORDS = ("the", "la", "der", "que")
HIT = "(" + " OR ".join(f"contains({{c}}, '{w}')" for w in ("thing", "ment", "ung", "ción")) + ")"
PHRASES = ["thing", "ment", "ung", "ción"]


# ── scans and filters ──
@query(EV + " SELECT room, t, line_no, user_id, type, content, k FROM ev")
def chat_scan_typed(spark: SparkSession, sf: str) -> DataFrame:
    return A.events(spark, sf).select("room", "t", "line_no", "user_id", "type", "content", "k")


@query("SELECT event_type, (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def props_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return A.table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (event_id % 10 <> 3) AS good, count(*) FILTER (event_id % 10 = 3) AS bad FROM events")
def bad_rows_split(spark: SparkSession, sf: str) -> DataFrame:
    # every tenth line is cut off, so that it is no JSON
    line = F.concat(F.lit('{"recvTimeSec":"'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 3, "").otherwise('"}'))
    known = F.from_json(line, "recvTimeSec string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = A.table(spark, sf, "events").select(known.alias("j")).select("j.*")
    return rows.agg(F.count_if(F.col("_corrupt_record").isNull()).alias("good"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))


@query("""SELECT page_id, (i - 1)::INTEGER AS pos, length(b[i]) AS n, md5(b[i]) AS body FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM
  (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS b FROM pages))""")
def page_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.scripts(A.table(spark, sf, "pages")).select("page_id", "pos", F.length("body").cast("long").alias("n"), F.md5("body").alias("body"))


@query("""SELECT page_id, count(*) AS links, count(DISTINCT h) AS distinct_links, min(h) AS first_href FROM
  (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY page_id""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_source.links(A.table(spark, sf, "pages"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("distinct_links"), F.min("href").alias("first_href"))


LIVE = """'<script nonce="a">self.x={"roomId":"' || page_id || '","user_unique_id":"7' || page_id || '","anchor":{"id_str":"5' || page_id || '","sec_uid":"s' || page_id || '"},"room":{"status":"2","title":"t ' || page_id || '"},"u":"http:\\/\\/h.example\\/pull-flv\\/a_hd.flv?x=1","v":"http:\\/\\/h.example\\/pull-flv\\/a_sd.flv?x=' || page_id || '"}</script>'"""


def live_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the script of a live room after their own text."""
    i = F.col("page_id").cast("string")
    parts = ['<script nonce="a">self.x={"roomId":"', i, '","user_unique_id":"7', i, '","anchor":{"id_str":"5', i, '","sec_uid":"s', i, '"},"room":{"status":"2","title":"t ', i, '"},"u":"http:\\/\\/h.example\\/pull-flv\\/a_hd.flv?x=1","v":"http:\\/\\/h.example\\/pull-flv\\/a_sd.flv?x=', i, '"}</script>']
    return A.table(spark, sf, "pages").withColumn("html", F.concat("html", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


@query("""SELECT page_id, 'hd' AS quality, 'http://h.example/pull-flv/a_hd.flv?x=1' AS url FROM pages
  UNION ALL SELECT page_id, 'sd', 'http://h.example/pull-flv/a_sd.flv?x=' || page_id FROM pages""")
def page_urls_by_quality(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.stream_urls(live_pages(spark, sf))


@query("SELECT page_id, url, page_id::VARCHAR AS room_id, '7' || page_id AS user_id, '5' || page_id AS anchor_id, 's' || page_id AS sec_uid, '2' AS status, 't ' || page_id AS title FROM pages")
def page_room_info(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.room_info(live_pages(spark, sf))


@query("SELECT DISTINCT event_type AS signal FROM events WHERE event_type NOT IN ('rms', 'motion')")
def unknown_signals_anti(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "events").select(F.col("event_type").alias("signal")).unionByName(spark.createDataFrame([("rms",), ("motion",)], "signal string"))
    return timeline.unknown_signals(rows)


@query("SELECT event_id % 7 AS key, count(*) AS n, substr(sha256((event_id % 7)::VARCHAR), 1, 16) AS user_hash FROM events GROUP BY ALL")
def user_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "events").groupBy((F.col("event_id") % 7).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("user_hash", text.user_hash(F.col("key")))


# ── time line ──
@query(EV + " SELECT room, t, count(ev.line_no)::BIGINT AS n FROM spine LEFT JOIN ev USING (room, t) GROUP BY room, t")
def spine_density(spark: SparkSession, sf: str) -> DataFrame:
    ev = A.events(spark, sf)
    full = timeline.dense(text.density(ev).withColumn("dmDensity", F.col("dmDensity").cast("double")), ev, A.HOURS, "dmDensity")
    return full.select("room", "t", F.col("dmDensity").cast("long").alias("n"))


@query(EV + " SELECT room, count(*) FILTER (t < 100 OR t > 599) AS skipped, count(*) AS rows FROM (SELECT room, t FROM ev) GROUP BY room")
def out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    moved = A.events(spark, sf).withColumn("t", F.col("t") - 100)
    return timeline.skipped(moved, 500)


ALIGN = """, old AS (SELECT room, signal, max(t) + 1 AS n FROM src GROUP BY room, signal),
pos AS (SELECT o.room, o.signal, o.n, x.t, x.t * (o.n - 1) / ({target} - 1)::DOUBLE AS p FROM old o CROSS JOIN (SELECT unnest(range({target}))::INTEGER AS t) x)
SELECT pos.room, pos.signal, pos.t, round(a.value + (p - floor(p)) * (b.value - a.value), 6) AS value
FROM pos JOIN src a ON a.room = pos.room AND a.signal = pos.signal AND a.t = floor(p) JOIN src b ON b.room = pos.room AND b.signal = pos.signal AND b.t = least(floor(p) + 1, pos.n - 1)"""


@query(SIG + ", src AS (SELECT * FROM sig WHERE signal IN ('rms', 'dmDensity') AND t < 700 - room)" + ALIGN.format(target=720))
def align_stretch(spark: SparkSession, sf: str) -> DataFrame:
    src = A.signals(spark, sf).where("signal IN ('rms', 'dmDensity') AND t < 700 - room")
    return timeline.align(src, 720).select("room", "signal", F.col("t").cast("int").alias("t"), r6("value").alias("value"))


@query(SIG + " SELECT room, signal, t, CASE WHEN t < 650 THEN value ELSE 0 END AS value FROM sig WHERE signal IN ('eventLaughter', 'sceneChange')")
def align_pad_event(spark: SparkSession, sf: str) -> DataFrame:
    src = A.signals(spark, sf).where("signal IN ('eventLaughter', 'sceneChange') AND t < 650")
    return timeline.align(src, 720).select("room", "signal", "t", "value")


@query(SIG + " SELECT room, signal, t, round(value, 6) AS value FROM sig WHERE t < 500")
def align_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.align(A.signals(spark, sf), 500).select("room", "signal", "t", r6("value").alias("value"))


@query(SIG + " SELECT room, signal, 700 AS old, 720 AS target, CASE WHEN signal IN ('sceneChange', 'eventLaughter') THEN 'pad' ELSE 'stretch' END AS how FROM sig GROUP BY room, signal")
def alignment_report(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.alignment_report(A.signals(spark, sf).where("t < 700"), 720)


@query(SIG + ", s AS (SELECT room, t, value FROM sig WHERE signal = 'rms' AND t < 600) SELECT p.room, p.t, round(s.value, 6) AS value FROM spine p JOIN s ON s.room = p.room AND s.t = least(p.t, 599)")
def edge_pad(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.signals(spark, sf).where("signal = 'rms' AND t < 600").select("room", "t", "value")
    return timeline.edge_pad(rows, A.HOURS).select("room", "t", r6("value").alias("value"))


@query(SIG + ", f AS (SELECT room, t // 31 AS u, value FROM sig WHERE signal = 'rms') SELECT s.room, s.u::INTEGER AS t, round(coalesce(avg(f.value), 0), 6) AS value FROM (SELECT room, unnest(range(30)) AS u FROM (SELECT DISTINCT room FROM sig)) s LEFT JOIN f ON f.room = s.room AND f.u = s.u GROUP BY s.room, s.u")
def frames_to_ticks(spark: SparkSession, sf: str) -> DataFrame:
    frames = A.signals(spark, sf).where("signal = 'rms'").select("room", F.col("t").alias("frame"), "value")
    return timeline.frames_to_ticks(frames, 30).select("room", "t", r6("value").alias("value"))


@query(SIG + ", b AS (SELECT unnest(range(100))::INTEGER AS bucket) SELECT room, bucket, round(max(value), 6) AS score FROM b JOIN sig ON signal = 'rms' AND t >= floor(bucket * 7.2::DOUBLE) AND t < greatest(floor(bucket * 7.2::DOUBLE) + 1, floor((bucket + 1) * 7.2::DOUBLE)) GROUP BY ALL")
def bucket_max(spark: SparkSession, sf: str) -> DataFrame:
    curve = A.signals(spark, sf).where("signal = 'rms'").select("room", "t", F.col("value").alias("score"))
    return timeline.bucket_max(curve, 100).select("room", "bucket", r6("score").alias("score"))


@query("SELECT conv_id AS room, turn::INTEGER AS idx, round(coalesce(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS starts FROM conversations")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    chunks = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("room"), F.col("turn").cast("int").alias("idx"), (F.length("text") / 10.0).alias("dur"))
    return timeline.chunk_offsets(chunks).select("room", "idx", r6("starts").alias("starts"))


@query(SIG + " SELECT room, t, signal, round(CASE WHEN signal = 'rms' THEN value * 2 ELSE value END, 6) AS value FROM sig WHERE signal <> 'rms' OR t < 100")
def source_overwrite_union(spark: SparkSession, sf: str) -> DataFrame:
    first = A.signals(spark, sf)
    second = first.where("signal = 'rms' AND t < 100").withColumn("value", F.col("value") * 2)
    return timeline.overwrite_union(first, second).select("room", "t", "signal", r6("value").alias("value"))


# ── text signals ──
@query(EV + " SELECT room, t, count(DISTINCT user_id) AS users FROM ev GROUP BY room, t")
def unique_users(spark: SparkSession, sf: str) -> DataFrame:
    return text.unique_users(A.events(spark, sf)).select("room", "t", F.col("dmUniqueUsers").alias("users"))


@query(TALK + " SELECT s.room, s.t, round(CASE WHEN count(item) = 0 THEN 1 ELSE count(DISTINCT item) / count(item)::DOUBLE END, 6) AS utr FROM spine s LEFT JOIN tok ON tok.room = s.room AND tok.t BETWEEN s.t - 1 AND s.t + 1 GROUP BY s.room, s.t")
def utr_window(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.talk(spark, sf)
    return text.token_diversity(chat, A.spine(chat, A.TURNS), 1).select("room", "t", r6("dmUtr").alias("utr"))


@query(EV + """, utr AS (SELECT s.room, s.t, CASE WHEN count(content) = 0 THEN 1 ELSE count(DISTINCT content) / count(content)::DOUBLE END AS u FROM spine s LEFT JOIN ev ON ev.room = s.room AND ev.t BETWEEN s.t - 30 AND s.t + 30 GROUP BY s.room, s.t),
d AS (SELECT room, t, count(*) AS n FROM ev GROUP BY room, t), thr AS (SELECT room, CASE WHEN count(*) < 60 THEN 0.3 ELSE greatest(0.15, least(0.6, quantile_cont(u, 0.2))) END AS thr FROM utr JOIN d USING (room, t) WHERE u > 0 GROUP BY room)
SELECT room, t, round(coalesce(n, 0) * CASE WHEN u > 0 THEN least(1, u / thr) ELSE 1 END, 6) AS density FROM utr JOIN thr USING (room) LEFT JOIN d USING (room, t)""")
def utr_calibrated_density(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.events(spark, sf)
    utr = text.token_diversity(chat, A.spine(chat, A.HOURS), 30)
    density = text.density(chat)
    return text.adjusted_density(density, utr, text.diversity_threshold(utr, density)).select("room", "t", r6("dmDensity").alias("density"))


@query(SIG + " SELECT room, t, coalesce(lead(value) OVER w - 2 * value + lag(value) OVER w, 0) AS acceleration FROM sig WHERE signal = 'dmDensity' WINDOW w AS (PARTITION BY room ORDER BY t)")
def acceleration(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.signals(spark, sf).where("signal = 'dmDensity'")
    return text.acceleration(rows).select("room", "t", F.col("dmAcceleration").alias("acceleration"))


@query(TALK + """, c AS (SELECT s.room, s.t, item, count(*) AS c FROM spine s JOIN tok ON tok.room = s.room AND tok.t BETWEEN s.t - 1 AND s.t + 1 GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY room, t) AS total, row_number() OVER (PARTITION BY room, t ORDER BY c DESC, item) AS place FROM c),
h AS (SELECT room, t, -sum(c / total::DOUBLE * log2(c / total::DOUBLE)) AS h FROM r WHERE place <= 50 GROUP BY room, t)
SELECT room, t, round(coalesce(h, 0), 6) AS entropy FROM spine LEFT JOIN h USING (room, t)""")
def entropy_window(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.talk(spark, sf)
    return text.entropy(chat, A.spine(chat, A.TURNS), 1).select("room", "t", r6("dmEntropy").alias("entropy"))


@query(TALK + """, m AS (SELECT room, t, sum((item IN ('the', 'la'))::INTEGER) AS p, sum((item IN ('der', 'que'))::INTEGER) AS n FROM tok GROUP BY room, t)
SELECT s.room, s.t, coalesce(sign(p - n) * 0.5::DOUBLE, 0) AS sentiment FROM spine s LEFT JOIN m ON m.room = s.room AND m.t = s.t""")
def sentiment_rules(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.talk(spark, sf)
    return text.sentiment(chat, A.spine(chat, A.TURNS), ("the", "la"), ("der", "que")).select("room", "t", F.col("dmSentiment").alias("sentiment"))


POSTS = """WITH chat AS (SELECT substr(source, 4)::BIGINT AS room, (doc_id // 5)::INTEGER AS t, doc_id AS line_no, text AS content FROM documents),
spine AS (SELECT room, t FROM (SELECT DISTINCT room FROM chat) CROSS JOIN (SELECT unnest(range((SELECT max(t) + 1 FROM chat)))::INTEGER AS t))"""


@query(POSTS + ", c AS (SELECT room, t, regexp_replace(lower(content), '\\s+', '', 'g') AS item FROM chat) SELECT s.room, s.t, round(CASE WHEN count(item) = 0 THEN 0 ELSE (count(item) - count(DISTINCT item)) / count(item)::DOUBLE END, 6) AS rate FROM spine s LEFT JOIN c ON c.room = s.room AND c.t BETWEEN s.t - 20 AND s.t + 20 AND item <> '' GROUP BY s.room, s.t")
def repeat_rate(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.posts(spark, sf)
    # as many ticks as the documents fill
    spine = chat.select("room").distinct().crossJoin(chat.agg(F.max("t").alias("last"))).select("room", F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    return text.repeat_rate(chat, spine, 20).select("room", "t", r6("dmRepeatRate").alias("rate"))


RATE = EV + " SELECT s.room, s.t, round(coalesce(count(*) FILTER ({hit}) / nullif(count(line_no), 0)::DOUBLE, 0), 6) AS rate FROM spine s LEFT JOIN ev ON ev.room = s.room AND ev.t BETWEEN s.t - 5 AND s.t + 5 GROUP BY s.room, s.t"


@query(RATE.format(hit="contains(content, '?')"))
def question_rate(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.events(spark, sf)
    return text.question_rate(chat, A.spine(chat, A.HOURS)).select("room", "t", r6("dmQuestionRate").alias("rate"))


@query(RATE.format(hit="contains(content, '!')"))
def exclaim_rate(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.events(spark, sf)
    return text.exclamation_rate(chat, A.spine(chat, A.HOURS)).select("room", "t", r6("dmExclamationRate").alias("rate"))


@query(RATE.format(hit="regexp_matches(content, '\\[[^\\[\\]]{1,8}\\]')"))
def emoji_rate(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.events(spark, sf)
    return text.emoji_rate(chat, A.spine(chat, A.HOURS)).select("room", "t", r6("dmEmojiRate").alias("rate"))


@query(TALK + """, r AS (SELECT s.room, s.t, coalesce(count(*) FILTER (""" + HIT.format(c="lower(content)") + """) / nullif(count(content), 0)::DOUBLE, 0) AS rate FROM spine s LEFT JOIN chat ON chat.room = s.room AND chat.t BETWEEN s.t - 1 AND s.t + 1 GROUP BY s.room, s.t),
h AS (SELECT DISTINCT s.room, s.t FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < least(ceil(asr.e), 8) WHERE """ + HIT.format(c="lower(text)") + """)
SELECT r.room, r.t, round(least(1, 0.6::DOUBLE * rate + CASE WHEN h.t IS NULL THEN 0 ELSE 0.4::DOUBLE END), 6) AS rate FROM r LEFT JOIN h ON h.room = r.room AND h.t = r.t""")
def keyword_category(spark: SparkSession, sf: str) -> DataFrame:
    chat = A.talk(spark, sf)
    rows = text.keyword_rate(chat, A.transcripts(spark, sf), A.spine(chat, A.TURNS), PHRASES, A.TURNS, "rate", 1)
    return rows.select("room", "t", r6("rate").alias("rate"))


COVER = "CASE WHEN ceil(asr.e) >= 8 THEN 7 ELSE ceil(asr.e) END"


@query(TALK + ", h AS (SELECT DISTINCT s.room, s.t FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < " + COVER + " WHERE " + HIT.format(c="text") + ") SELECT s.room, s.t, (h.t IS NOT NULL)::INTEGER::DOUBLE AS hit FROM spine s LEFT JOIN h ON h.room = s.room AND h.t = s.t")
def asr_keyword(spark: SparkSession, sf: str) -> DataFrame:
    asr = A.transcripts(spark, sf)
    return text.asr_keyword(asr, A.spine(asr, A.TURNS), PHRASES, A.TURNS).select("room", "t", F.col("asrKeyword").alias("hit"))


@query(TALK + """, x AS (SELECT s.room, s.t, speaker, lag(speaker) OVER (PARTITION BY s.room, s.t ORDER BY seg_idx) AS before FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < """ + COVER + """),
h AS (SELECT DISTINCT room, t FROM x WHERE before <> speaker) SELECT s.room, s.t, (h.t IS NOT NULL)::INTEGER::DOUBLE AS changed FROM spine s LEFT JOIN h ON h.room = s.room AND h.t = s.t""")
def speaker_change(spark: SparkSession, sf: str) -> DataFrame:
    asr = A.transcripts(spark, sf)
    return text.speaker_change(asr, A.spine(asr, A.TURNS), A.TURNS).select("room", "t", F.col("speakerChange").alias("changed"))


@query("""WITH w AS (SELECT conv_id, turn, i, lower(ws[i]) AS word FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM
  (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '\\[[^\\]]{0,8}\\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_+-]{1,}') AS ws FROM conversations))),
c AS (SELECT conv_id AS room, word, count(*) AS n, min({'l': turn, 'i': i}) AS first FROM w GROUP BY ALL),
r AS (SELECT room, word, n, row_number() OVER (PARTITION BY room ORDER BY n DESC, first)::INTEGER AS rank FROM c) SELECT * FROM r WHERE rank <= 20""")
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_words(report.chat_messages(A.talk(spark, sf)))


@query("""WITH w AS (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '\\[[^\\]]{0,8}\\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_+-]{1,}'), lambda x: lower(x)) AS a FROM benchmark)
SELECT item_id, len(a)::INTEGER + 9 AS n, array_to_string(list_concat(['高能', '名场', '场面', '面来', '来了', '名场面', '场面来', '面来了', '太强了'], a), '|') AS tokens FROM w""")
def ngram_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = report.ngram_tokens(F.concat(F.lit("[x]高能 名场面来了 太强了 "), "text"))
    return A.table(spark, sf, "benchmark").select("item_id", F.size(tokens).alias("n"), F.array_join(tokens, "|").alias("tokens"))


@query("""WITH k AS (SELECT vec_id AS key_id, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 8),
s AS (SELECT v.vec_id, key_id, list_dot_product(v.embedding::DOUBLE[], e::DOUBLE[]) / ((sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-10) * (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) + 1e-10)) AS sim FROM embeddings v CROSS JOIN k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, key_id) AS place FROM s) SELECT vec_id, key_id, round(sim, 6) AS similarity FROM r WHERE place = 1 AND sim > 0.3""")
def cosine_match(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors against a list of eight keys: the vectors of the eight smallest ids, whatever those are."""
    vectors = A.table(spark, sf, "embeddings")
    keys = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding").orderBy("vec_id").limit(8).collect()]
    return text.fuzzy_match(vectors, sorted(keys), 0.3).select("vec_id", "key_id", r6("similarity").alias("similarity"))


@query()
def topic_change(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as recordings of up to 900 ticks, one after another."""
    rows = A.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 900).cast("long").alias("room"), F.pmod(F.col("vec_id"), F.lit(900)).cast("int").alias("t"), F.col("embedding").alias("features"))
    return text.topic_change(rows)


@query("SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'highEnergy' WHEN 'view' THEN 'funny' END AS category, count(*) AS n FROM events GROUP BY ALL")
def category_names(spark: SparkSession, sf: str) -> DataFrame:
    alias = F.when(F.col("name") == "click", "High_Energy").when(F.col("name") == "view", "FUNNY").otherwise("other")
    rows = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("name", text.category(alias).alias("category"), "n")


# ── transcripts, subtitles, annotations ──
@query("SELECT conv_id AS room, turn::INTEGER AS seg_idx, turn::DOUBLE AS \"start\", turn::DOUBLE + 2 AS \"end\", md5(text) AS text, role AS speaker FROM conversations")
def transcript_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.transcripts(spark, sf)
    item = F.to_json(F.struct("start", "end", "text", "speaker"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", item.alias("doc")))), lambda x: x["doc"])
    # even rooms have a bare list, odd ones an object
    docs = rows.groupBy("room").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("doc"))
    docs = docs.withColumn("doc", F.when(F.col("room") % 2 == 0, F.col("doc")).otherwise(F.concat(F.lit('{"status":"ok","segments":'), F.col("doc"), F.lit("}"))))
    return chat_source.segments(docs).withColumn("text", F.md5("text"))


@query("SELECT conv_id AS room, CASE conv_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'failed' WHEN 3 THEN 'invalid' ELSE 'missing' END AS status FROM conversations GROUP BY ALL")
def transcript_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("room") % 5
    doc = F.when(kind == 0, '[{"start":0,"end":1,"text":"a"}]').when(kind == 1, '{"segments":[]}').when(kind == 2, '{"status":"failed","error":"x"}').when(kind == 3, "no json").otherwise("")
    return A.talk(spark, sf).select("room").distinct().select("room", chat_source.transcript_status(doc).alias("status"))


@query("SELECT conv_id AS room, (turn + 1)::INTEGER AS idx, turn * 3.5::DOUBLE AS \"start\", turn * 3.5::DOUBLE + 2 AS \"end\", role AS text FROM conversations")
def srt_cues(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("turn") * 3.5
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), report.srt_time(start), F.lit(" --> "), report.srt_time(start + 2), F.lit("\r\n"), F.col("role"))
    rows = A.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("room"))
    docs = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\r\n\r\n").alias("doc"))
    return chat_source.parse_srt(docs)


@query("""WITH c AS (SELECT conv_id AS room, turn * 3.5::DOUBLE AS s, turn * 3.5::DOUBLE + 2 AS e, role FROM conversations)
SELECT room, row_number() OVER (PARTITION BY room ORDER BY s)::INTEGER AS number, greatest(0, s - 5) AS "from", least(10, e - 5) AS till, role AS text FROM c WHERE e >= 5 AND s <= 15""")
def clip_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("turn") * 3.5
    cues = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("room"), start.alias("start"), (start + 2).alias("end"), F.col("role").alias("text"))
    clips = cues.select("room").distinct().select("room", F.lit(1).alias("id"), F.lit(5.0).alias("start"), F.lit(15.0).alias("end"))
    return report.clip_subtitles(cues, clips).drop("id")


@query("SELECT label_id, label || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS label FROM (SELECT doc_id AS label_id, 'x' || CASE WHEN quality = 0 THEN '' ELSE coalesce(quality::VARCHAR, '') END AS label, row_number() OVER (PARTITION BY 'x' || CASE WHEN quality = 0 THEN '' ELSE coalesce(quality::VARCHAR, '') END ORDER BY doc_id) AS n FROM labels)")
def unique_labels(spark: SparkSession, sf: str) -> DataFrame:
    from tidepeak.operators import evaluate

    # a label for each quality, x for 0
    label = F.when(F.col("quality") == 0, "x").otherwise(F.concat(F.lit("x"), F.coalesce(F.col("quality").cast("string"), F.lit(""))))
    rows = A.table(spark, sf, "labels").select(F.col("doc_id").alias("idx"), label.alias("label"))
    return evaluate.unique_labels(rows).select(F.col("idx").alias("label_id"), "label")


# ── reports ──
@query("SELECT p_partkey, substr(regexp_replace(p_name || ' #' || p_brand || '/(' || p_type || ')', '[^\\p{L}\\p{N} _+-]', '', 'g'), 1, 30) AS safe FROM part")
def safe_filenames(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("/("), "p_type", F.lit(")"))
    return A.table(spark, sf, "part").select("p_partkey", report.safe_name(name).alias("safe"))


@query("SELECT p_partkey, printf('%02d:%02d:%02d,%03d', (p_partkey * 13 // 3600)::INTEGER, (p_partkey * 13 % 3600 // 60)::INTEGER, (p_partkey * 13 % 60)::INTEGER, 250) AS srt FROM part")
def srt_times(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select("p_partkey", report.srt_time(F.col("p_partkey") * 13 + 0.25).alias("srt"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'drop' WHEN p_size % 2 = 0 THEN 'review' ELSE 'keep' END AS action FROM part")
def suggested_action(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda c, name: F.filter(F.array(F.when(c, F.lit(name))), lambda x: x.isNotNull())
    action = report.suggested_action(flag(F.col("p_size") % 2 == 0, "low_novelty"), flag(F.col("p_size") % 3 == 0, "overlap"))
    return A.table(spark, sf, "part").select("p_partkey", action.alias("action"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'given' ELSE p_brand || CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size > 20 THEN '|size|two' ELSE '|two|size' END ELSE '|size' END END AS reasons FROM part""")
def reasons_fallback(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    given = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("given")))
    parts = F.create_map(F.lit("size"), size, F.lit("two"), F.when(F.col("p_size") % 2 == 0, F.lit(20.5)).otherwise(F.lit(-90.0)))
    return A.table(spark, sf, "part").select("p_partkey", F.array_join(report.reasons(given, F.col("p_brand"), parts), "|").alias("reasons"))


@query("SELECT reason, n, place, o_orderkey FROM (SELECT o_orderpriority AS reason, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INTEGER AS place FROM orders) WHERE place <= 200")
def reason_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("reason"), F.col("o_totalprice").alias("start"), F.col("o_orderkey").alias("end"))
    return report.reason_groups(rows).select("reason", "n", "place", F.col("end").alias("o_orderkey"))


@query("""SELECT room, count(*) AS messages, count(*) FILTER (type = 'click') AS chats, count(DISTINCT user_id) AS users, CASE WHEN count(*) FILTER (type = 'click') = 0 THEN 0 WHEN count(*) FILTER (type = 'click') < 100 THEN 1 WHEN count(*) FILTER (type = 'click') < 1000 THEN 2 ELSE 3 END AS level
FROM (SELECT user_id % 5 AS room, user_id, event_type AS type FROM events) GROUP BY room""")
def chat_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.events(spark, sf).withColumn("type", F.when(F.col("type") == "click", "chat").otherwise(F.col("type")))
    return report.chat_stats(rows)


@query("SELECT conv_id AS room, count(*) AS segments, count(*) * 2.0::DOUBLE AS speech, md5(substr(string_agg(text, ' ' ORDER BY turn), 1, 1500)) AS text FROM conversations GROUP BY conv_id")
def transcript_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.transcript_summary(A.transcripts(spark, sf)).withColumn("text", F.md5("text"))


@query("SELECT o_orderpriority AS mode, min(o_totalprice) AS least, median(o_totalprice) AS middle, max(o_totalprice) AS most FROM orders GROUP BY ALL")
def timing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.timing_summary(A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("seconds")))


@query("SELECT p_partkey, CASE WHEN p_size * 100003 >= 1048576 THEN printf('%.1f MB', p_size * 100003 / 1048576.0) WHEN p_size * 100003 >= 1024 THEN printf('%.1f KB', p_size * 100003 / 1024.0) ELSE p_size * 100003 || ' B' END AS size FROM part")
def file_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select("p_partkey", report.file_size(F.col("p_size") * 100003).alias("size"))


# ── manifests ──
@query("""SELECT o_orderkey AS artifact, o_orderkey % 6 = 5 AS hit, CASE o_orderkey % 6 WHEN 0 THEN 'artifact missing' WHEN 1 THEN 'generator changed' WHEN 2 THEN 'parameters changed' WHEN 3 THEN 'artifact modified' WHEN 4 THEN 'source changed' ELSE 'cache hit' END AS reason FROM orders""")
def artifact_reuse(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey") % 6
    pick = lambda n, other, same: F.when(key == n, F.lit(other)).otherwise(F.lit(same))
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey"))
    known = orders.select(
        F.col("o_orderkey").alias("artifact"), F.lit(manifest.VERSION).alias("schema_version"), pick(1, "old", manifest.GENERATOR).alias("generator"), F.lit("score").alias("step"), F.lit("s").alias("settings"),
        pick(2, "q", "p").alias("params"), F.create_map(F.lit("in.json"), pick(4, "x", "y")).alias("source_digests"), pick(3, "e", "d").alias("digest"),
    )
    now = orders.select(
        F.col("o_orderkey").alias("artifact"), F.lit("score").alias("step"), F.lit("s").alias("settings"), F.lit("p").alias("params"), F.create_map(F.lit("in.json"), F.lit("y")).alias("sources"), F.when(key != 0, F.lit("d")).alias("digest"),
    )
    return manifest.reuse(known, now).select("artifact", "hit", "reason")


@query("""SELECT o_custkey AS run, o_orderpriority AS step, arg_max(CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'failed' END, o_orderkey) AS status,
  coalesce(max(o_orderkey) - min(o_orderkey) FILTER (o_orderstatus = 'O'), 0) AS elapsed_ms FROM orders GROUP BY ALL""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "ok").otherwise("failed")
    rows = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("step"), F.col("o_orderkey").alias("ts_ms"), status.alias("status"))
    return manifest.run_status(rows)


@query("SELECT o_orderkey AS idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = A.table(spark, sf, "orders").select(F.lit("s").alias("signature"), F.col("o_orderkey").alias("idx"))
    done = A.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.lit("s").alias("signature"), F.col("l_orderkey").alias("idx"))
    return manifest.pending_chunks(chunks, done).select("idx")


@query("SELECT p_partkey AS artifact, CASE WHEN p_size % 5 = 0 THEN 'missing' WHEN p_size % 5 = 1 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN p_size % 5 < 2 THEN 0 ELSE 2 END AS features, CASE WHEN p_size % 5 >= 2 AND p_size < 8 THEN 'rms' ELSE '' END AS misaligned FROM part")
def feature_status(spark: SparkSession, sf: str) -> DataFrame:
    ones = lambda n: F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("double"))
    full = F.create_map(F.lit("motion"), ones(F.lit(10)), F.lit("rms"), ones(F.greatest(F.lit(1), F.least(F.col("p_size"), F.lit(9)) + F.when(F.col("p_size") < 8, 0).otherwise(1))))
    empty = F.create_map(F.lit("rms"), F.array().cast("array<double>"))
    kind = F.col("p_size") % 5
    features = F.when(kind == 0, F.lit(None).cast("map<string,array<double>>")).when(kind == 1, empty).otherwise(full)
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("artifact"), F.when(kind == 1, 0.0).otherwise(10.0).alias("duration"), features.alias("features"))
    return manifest.feature_status(rows).withColumn("misaligned", F.array_join("misaligned", ","))


@query("SELECT signal, place FROM (VALUES ('rms', 0), ('dmDensity', 7), ('sceneChange', 26), ('other', 29)) v(signal, place)")
def signal_order(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("rms",), ("dmDensity",), ("sceneChange",), ("other",)], "signal string").select("signal", order_of(F.col("signal")).alias("place"))

