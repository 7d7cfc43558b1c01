"""Queries of sources, documents and comparisons, on what the given tables make of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepeak.functions.settle import shared_path
from tidepeak.operators import evaluate, intervals, report, text
from tidepeak.plans import adapters as A
from tidepeak.plans import documents
from tidepeak.plans.catalogue import EV, RANGES, ROBUST, query, r6
from tidepeak.plans.queries_curves import z_and_weights
from tidepeak.plans.queries_intervals import EXPAND, MERGE, parts
from tidepeak.plans.queries_text import HIT, PHRASES, TALK
from tidepeak.sources import chat, frames, pages
from tidepeak.streaming import live


# ── weights of given tables ──
MODES = "WITH q AS (SELECT o_orderpriority AS profile, o_orderstatus AS signal, sum(o_totalprice)::DOUBLE AS q FROM orders GROUP BY ALL), w AS (SELECT profile, signal, q / sum(q) OVER (PARTITION BY profile) AS w FROM q)"


def mode_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities of orders as profiles: the share of each status in their price."""
    sums = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("signal")).agg(F.sum("o_totalprice").cast("double").alias("q"))
    return sums.select("profile", "signal", (F.col("q") / F.sum("q").over(Window.partitionBy("profile"))).alias("w"))


@query(MODES + " SELECT a.profile AS \"left\", b.profile AS \"right\", round(sum(abs(a.w - b.w)) / 2, 6) AS total_variation, round(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))), 6) AS cosine FROM w a JOIN w b ON a.signal = b.signal AND a.profile < b.profile GROUP BY ALL")
def weight_distances(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.profile_pairs(mode_weights(spark, sf)).select("left", "right", r6("total_variation").alias("total_variation"), r6("cosine").alias("cosine"))


@query(MODES + """, a AS (SELECT signal, w FROM w WHERE profile = '1-URGENT' AND signal <> 'F'), b AS (SELECT signal, w FROM w WHERE profile = '5-LOW' AND signal <> 'O'), j AS (SELECT coalesce(a.w, 0) AS x, coalesce(b.w, 0) AS y FROM a FULL JOIN b USING (signal))
SELECT round(sum(abs(x - y)) / 2, 6) AS total_variation, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine FROM j""")
def weight_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Two vectors of which each lacks a name of the other."""
    w = mode_weights(spark, sf)
    out = evaluate.profile_distance(w.where("profile = '1-URGENT' AND signal <> 'F'"), w.where("profile = '5-LOW' AND signal <> 'O'"))
    return out.select(r6("total_variation").alias("total_variation"), r6("cosine").alias("cosine"))


@query(MODES + ", r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY w DESC, signal)::INTEGER AS place FROM w) SELECT profile AS variant, place, signal, round(w, 6) AS w FROM r WHERE place <= 2")
def strongest_weights(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.top_features(mode_weights(spark, sf).withColumnRenamed("profile", "variant"), 2)


@query(ROBUST + """, s AS (SELECT room, signal, any_value(ord) AS ord, round(any_value(w), 4) AS weight, round(any_value(w) * avg(abs(value)), 4) AS c FROM z JOIN weights USING (signal) GROUP BY room, signal),
a AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY c DESC, ord) AS rank FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY CASE WHEN rank <= 2 THEN rank END NULLS LAST, c DESC, ord)::INTEGER AS place FROM a)
SELECT room, place, signal, round(greatest(2, c / max(c) OVER (PARTITION BY room) * 100), 4) AS share FROM b WHERE place <= 4""")
def shown_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Which signals of a room a report shows, and how wide their bars are."""
    return report.signal_order(documents.signal_stats(*z_and_weights(spark, sf)), 2, 4).withColumn("share", F.round("share", 4))


@query("""WITH r AS (SELECT l_suppkey % 10 AS room, CASE l_linenumber % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'game' ELSE 'talent' END AS variant, count(*) AS top, count(*) FILTER (l_returnflag = 'R') AS matched, count(*) FILTER (l_returnflag <> 'N') AS positives FROM lineitem GROUP BY ALL),
o AS (SELECT *, CASE room % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'game' ELSE 'talent' END AS own FROM r),
j AS (SELECT own AS profile, count(*) FILTER (variant = own) AS cases, sum(positives) FILTER (variant = own)::BIGINT AS positives, round(2.0::DOUBLE * sum(matched) FILTER (variant = own) / sum(top + positives) FILTER (variant = own), 4) AS micro_f1, round(2.0::DOUBLE * sum(matched) FILTER (variant = 'default') / sum(top + positives) FILTER (variant = 'default'), 4) AS default_f1 FROM o GROUP BY own)
SELECT profile, cases, positives, micro_f1, default_f1, round(micro_f1 - default_f1, 4) AS delta, CASE WHEN profile = 'default' THEN 'keep' WHEN micro_f1 - default_f1 >= 0.0001 THEN 'keep' ELSE 'merge_into_default' END AS recommendation FROM j""")
def profile_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles on their own cases against the default on the same ones."""
    named = lambda n: F.when(n % 3 == 0, "default").when(n % 3 == 1, "game").otherwise("talent")
    rows = A.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("string").alias("room"), named(F.col("l_linenumber")).alias("variant"))
    by_case = rows.agg(F.count(F.lit(1)).alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("matched"), F.count_if(F.col("l_returnflag") != "N").alias("positives"))
    cases = by_case.select("room").distinct().select("room", named(F.col("room").cast("int")).alias("profile"))
    out = evaluate.compare_profiles(by_case, cases, min_delta=0.0001)
    return out.select("profile", "cases", "positives", "micro_f1", "default_f1", F.round("delta", 4).alias("delta"), "recommendation")


# ── documents as sources ──
def object_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


@query("""WITH r AS (SELECT o_custkey AS room, o_orderkey % 40 - 3 AS s, o_orderkey % 40 - 3 + o_orderkey % 5 - 1 AS e, o_orderkey % 7 AS q, CASE WHEN o_orderkey % 4 = 0 THEN 'd' || o_orderkey % 2 END AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
i AS (SELECT room, s, e, q, coalesce(id, 'a' || n) AS id FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY room, id) AS same FROM i)
SELECT room, id, s::DOUBLE AS "start", CASE WHEN s < 0 THEN 'negative start' WHEN e <= s THEN 'empty interval' WHEN q NOT BETWEEN 1 AND 5 THEN 'quality out of range' WHEN same > 1 THEN 'repeated id' END AS problem FROM c""")
def annotation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as annotation documents of customers: the valid ones, and why the others are not."""
    key = F.col("o_orderkey")
    item = F.struct(key.alias("k"), F.struct(F.when(key % 4 == 0, F.concat(F.lit("d"), (key % 2).cast("string"))).alias("id"), (key % 40 - 3).cast("double").alias("start"), (key % 40 - 3 + key % 5 - 1).cast("double").alias("end"), (key % 7).cast("string").alias("quality")).alias("a"))
    lists = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("room")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"])).alias("doc"))
    docs = lists.withColumn("doc", F.when(F.col("room") % 2 == 0, F.col("doc")).otherwise(F.concat(F.lit('{"annotations":'), F.col("doc"), F.lit("}"))))
    good, bad = chat.annotations(docs)
    out = good.select("room", "id", "start", F.lit(None).cast("string").alias("problem"))
    return out.unionByName(with_starts(bad.distinct(), docs))


def with_starts(problems: DataFrame, docs: DataFrame) -> DataFrame:
    """(room, id, start, problem) of rejected annotations, by judging each of the documents' items alone against what they were rejected for."""
    item = "array<struct<id:string,start:double,end:double,quality:string>>"
    each = docs.select("room", F.posexplode(F.from_json(F.regexp_extract("doc", r"(\[[\s\S]*\])", 1), item)).alias("pos", "a")).select("room", "pos", "a.*")
    each = each.withColumn("id", F.coalesce("id", F.concat(F.lit("a"), (F.col("pos") + 1).cast("string"))))
    why = F.when(F.col("start") < 0, "negative start").when(F.col("end") <= F.col("start"), "empty interval").when(~F.col("quality").cast("int").between(1, 5), "quality out of range").otherwise("repeated id")
    return each.withColumn("problem", why).join(problems.select("room", "id", "problem"), ["room", "id", "problem"], "left_semi").select("room", "id", "start", "problem")


@query("SELECT s_suppkey AS room, 'a' AS signal, 0 AS t, s_suppkey::DOUBLE AS value FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, 'a', 1, s_nationkey / 2::DOUBLE FROM supplier WHERE s_suppkey % 5 > 0")
def feature_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as feature files: empty and null arrays, and files without features, give nothing."""
    doc = F.concat(F.lit('{"features":{"a":['), F.col("s_suppkey").cast("string"), F.lit(","), (F.col("s_nationkey") / 2).cast("string"), F.lit('],"b":[],"c":null}}'))
    docs = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("room"), F.when(F.col("s_suppkey") % 5 > 0, doc).when(F.col("s_suppkey") % 2 == 0, '{"features":null}').alias("doc"))
    return chat.feature_signals(docs)


@query("""WITH c AS (SELECT c_custkey AS room, CASE WHEN c_custkey % 4 = 0 THEN 'talent' WHEN c_custkey % 3 = 0 THEN 'game' WHEN c_custkey % 7 = 0 THEN 'odd' ELSE 'default' END AS profile, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE WHEN c_custkey % 4 = 0 THEN 9 END AS duration, c_custkey % 3 AS n FROM customer WHERE c_custkey % 5 > 0)
SELECT room, profile, duration, n::INTEGER AS clips, profile <> 'odd' AS known FROM c""")
def time_table_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as time tables, some with annotations: which profile and duration count, and which profiles nobody knows."""
    key = F.col("c_custkey")
    clip = '{"start":1,"end":2}'
    clips = F.when(key % 3 == 0, "null").when(key % 3 == 1, f"[{clip}]").otherwise(f"[{clip},{clip}]")
    head = F.concat(F.lit('{"profile":"'), F.when(key % 3 == 0, "game").when(key % 7 == 0, "odd").otherwise(""), F.lit('",'), F.when(key % 2 == 0, F.concat(F.lit('"duration":'), key.cast("string"), F.lit(","))).otherwise(""), F.lit('"clips":'), clips, F.lit("}"))
    rows = A.table(spark, sf, "customer")
    tables = rows.select(key.alias("room"), F.when(key % 5 == 0, "[]").otherwise(head).alias("doc"))
    notes = rows.where("c_custkey % 4 = 0").select(key.alias("room"), F.lit('{"profile":"talent","duration":9}').alias("doc"))
    good, bad = evaluate.loaded_cases(tables, notes)
    every = evaluate.loaded_cases(tables, notes, ("default", "game", "talent", "odd"))[0]
    known = good.select("room", F.lit(True).alias("known")).unionByName(bad.select("room", F.lit(False).alias("known")))
    return every.join(known, "room").select("room", "profile", "duration", F.size("clips").alias("clips"), "known")


@query("SELECT '{\"n\":' || o_orderkey || '}' AS line FROM orders WHERE o_orderkey % 3 = 1")
def json_object_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as lines of a file, of which only objects are read back."""
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, "[1]").when(key % 3 == 1, F.concat(F.lit(' {"n":'), key.cast("string"), F.lit("}"))).otherwise('{"broken')
    path = shared_path(spark, "lines")
    A.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return chat.read_json_objects(spark, path)


METHODS = {"click": "WebcastChatMessage", "view": "WebcastLikeMessage", "purchase": "WebcastGiftMessage"}


@query("""SELECT event_id AS seq_id, user_id AS service, event_type || ' é' AS payload_type, CASE event_type WHEN 'click' THEN 'chat' WHEN 'view' THEN 'like' WHEN 'purchase' THEN 'gift' ELSE 'unknown' END AS type, length(props)::INTEGER AS size, 'v' || event_id % 7 AS header, 0 AS log_id FROM events""")
def frame_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as binary frames, decoded again, with the type of message that each method gives."""
    method = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in METHODS.items()], F.lit("WebcastOther"))
    fields = F.struct(F.col("event_id").alias("seq_id"), F.col("user_id").alias("service"), F.concat("event_type", F.lit(" é")).alias("payload_type"), F.encode("props", "UTF-8").alias("payload"), method.alias("msg_id"), F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")).alias("mark"))

    @F.arrow_udf("binary")
    def wired(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([frames.encode({**row, "headers": {"h": row["mark"]}}) for row in batch.to_pylist()], pa.binary())

    f = A.table(spark, sf, "events").select(wired(fields).alias("wire")).select(frames.decode_column(F.col("wire")).alias("f"))
    return f.select("f.seq_id", "f.service", "f.payload_type", frames.message_type(F.col("f.msg_id")).alias("type"), F.octet_length("f.payload").alias("size"), F.try_element_at("f.headers", F.lit("h")).alias("header"), F.col("f.log_id").cast("int").alias("log_id"))


@query("SELECT page_id, unnest(['{\"roomId\":\"r' || page_id || '\",\"kind\":\"render\"}', '{\"roomId\":\"r' || page_id || '\",\"kind\":\"state\"}']) AS doc FROM pages")
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """JSON inside pages: an encoded render document, and one after a state marker, behind the pages' own text."""
    room = F.concat(F.lit('{"roomId":"r'), F.col("page_id").cast("string"))
    render = F.concat(F.lit('<script id="RENDER_DATA" type="application/json">'), F.url_encode(F.concat(room, F.lit('","kind":"render"}'))), F.lit("</script>"))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), room, F.lit('","kind":"state"}; more()</script>'))
    rows = A.table(spark, sf, "pages").withColumn("html", F.concat("html", render, state))
    return pages.embedded_json(rows).select("page_id", "doc").where(F.get_json_object("doc", "$.roomId") == F.concat(F.lit("r"), F.col("page_id").cast("string"))).distinct()


# ── chat ──
@query("SELECT user_id % 5 AS room, count(*) AS n FROM events WHERE event_id % 10 > 0 AND event_type IN ('click', 'view', 'signup') GROUP BY ALL")
def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events that count as messages: with text, and of a type that is chat, empty or missing."""
    rows = A.events(spark, sf).withColumns({"content": F.when(F.col("line_no") % 10 == 0, "  ").otherwise(F.col("content")), "type": F.when(F.col("type") == "click", "chat").when(F.col("type") == "signup", "").when(F.col("type") != "view", F.col("type"))})
    return report.chat_messages(rows).groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@query(TALK + """, m AS (SELECT room, t, sign(sum((item IN ('the', 'la'))::INTEGER) - sum((item IN ('der', 'que'))::INTEGER)) * 0.5::DOUBLE AS r FROM tok GROUP BY room, t),
j AS (SELECT room, t, coalesce(r, 0) AS r, CASE t % 3 WHEN 0 THEN 0.9 WHEN 1 THEN -0.25 END::DOUBLE AS j FROM chat LEFT JOIN m USING (room, t))
SELECT room, t, r AS rules, CASE WHEN r <> 0 THEN r ELSE coalesce(j, r) END AS hybrid, coalesce(j, r) AS hf FROM j""")
def mood_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Mood of each message by rules, by a model where these are neutral, and by the model, which has none for every third turn."""
    model = lambda content: F.when(F.col("t") % 3 == 0, 0.9).when(F.col("t") % 3 == 1, -0.25)
    moods = {mode: text.mood_of(F.col("content"), mode, model, positive=("the", "la"), negative=("der", "que")) for mode in ("rules", "hybrid", "hf")}
    return A.talk(spark, sf).select("room", "t", *[m.alias(name) for name, m in moods.items()])


@query(TALK + ", h AS (SELECT DISTINCT s.room, s.t FROM spine s JOIN asr ON asr.room = s.room AND s.t >= asr.s AND s.t < CASE WHEN ceil(asr.e) >= 8 THEN 7 ELSE ceil(asr.e) END WHERE " + HIT.format(c="text") + " OR seg_idx % 4 = 0) SELECT s.room, s.t, (h.t IS NOT NULL)::INTEGER::DOUBLE AS hit FROM spine s LEFT JOIN h ON h.room = s.room AND h.t = s.t")
def spoken_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks whose transcript has a phrase, or, if not, a vector close to one of a phrase."""
    asr = A.transcripts(spark, sf).withColumn("vector", F.when(F.col("seg_idx") % 4 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    return text.asr_keyword(asr, A.spine(asr, A.TURNS), PHRASES, A.TURNS, [[1.0, 0.0]]).select("room", "t", F.col("asrKeyword").alias("hit"))


@query("SELECT conv_id AS room, least(count(*), 3)::BIGINT AS held, md5(arg_max(text, turn)) AS newest FROM conversations GROUP BY conv_id")
def recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The newest messages of conversations as a stream, of which three are held."""
    rows = live.read_events(spark, sf, "conversations.parquet").select(F.col("conv_id").alias("room"), F.col("turn").cast("int").alias("t"), F.col("turn").alias("line_no"), F.col("text").alias("content"))
    path = shared_path(spark, "recent")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    query = live.recent(rows, 3).writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    # a room whose messages come in several batches is told after each
    last = spark.read.parquet(path).groupBy("room").agg(F.max_by(F.struct("held", "newest"), "batch").alias("last"))
    return last.select("room", "last.held", F.md5("last.newest").alias("newest"))


# ── result documents ──
@query(RANGES + EXPAND + MERGE + """, dr AS (SELECT room, count(*) AS n FROM reach WHERE s - reach < 3 GROUP BY room), cl AS (SELECT room, count(*) AS n, min(s) AS s, round(max(score), 6) AS best FROM final GROUP BY room)
SELECT cl.room, cl.room::VARCHAR AS room_id, 720 AS duration, 'game' AS profile, cl.n AS clips, cl.s AS first, best, coalesce(dr.n, 0) AS dropped, 0 AS adjustments FROM cl LEFT JOIN dr USING (room)""")
def time_table_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Time tables as JSON documents, read back: what was kept of each room, where it starts, and what was dropped."""
    _, _, curve, ranges = parts(spark, sf)
    wide = intervals.expand(ranges, curve, 5.0, 24.0)
    clips = intervals.best_subwindow(intervals.merge_near(wide, 3.0), curve, 24.0)
    docs = documents.time_table(curve, clips, intervals.merged_away(wide, 3.0), clips.select("room", "start", "end", F.lit("x").alias("reason")).where("false"), "game")
    d = F.from_json("doc", "struct<roomId:string,duration:int,profile:string,clips:array<struct<start:double,score:double>>,dropped:array<struct<reason:string>>,adjustments:array<struct<reason:string>>>").alias("d")
    rows = docs.select("room", d)
    return rows.select(
        "room", F.col("d.roomId").alias("room_id"), "d.duration", "d.profile", F.size("d.clips").cast("long").alias("clips"), F.col("d.clips")[0]["start"].alias("first"), F.round(F.array_max(F.col("d.clips.score")), 6).alias("best"),
        F.size("d.dropped").cast("long").alias("dropped"), F.size("d.adjustments").alias("adjustments"),
    )


@query(EV + """, s AS (SELECT room, t, type, round(avg(value), 4) AS v FROM ev GROUP BY ALL) SELECT room, t AS id, type AS trigger, v AS score FROM s""")
def clip_files(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document for each kind of event of an hour, read back."""
    rows = A.events(spark, sf).groupBy("room", F.col("t").alias("id"), F.col("type").alias("trigger")).agg(F.round(F.avg("value"), 4).alias("score"))
    docs = documents.clip_documents(rows)
    return docs.select("room", F.get_json_object("doc", "$.id").cast("int").alias("id"), F.get_json_object("doc", "$.trigger").alias("trigger"), F.get_json_object("doc", "$.score").cast("double").alias("score"))
