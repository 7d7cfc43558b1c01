"""The driver's tables as tables of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.operators import timeline
from tidepeak.schema import SIGNALS

#: Hours of the event tables, which start at START (seconds since 1970).
HOURS, START = 720, 1704067200
#: Turns of a conversation.
TURNS = 8
#: Signals that event tables give.
FROM_EVENTS = ("rms", "eventLaughter", "dmDensity", "dmUniqueUsers", "sceneChange")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by room and hour, as chat: a mark at the end of the content depends on the event's props."""
    k = F.get_json_object("props", "$.k").cast("int")
    mark = F.when(k % 7 == 0, "?").when(k % 5 == 0, "!").when(k % 11 == 0, "[x]").otherwise("")
    rows = table(spark, sf_dir, "events")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - START) / 3600).cast("int")
    return rows.select(
        (F.col("user_id") % 5).alias("room"), t.alias("t"), F.col("event_id").alias("line_no"), "user_id", F.col("event_type").alias("type"),
        F.concat("event_type", mark).alias("content"), "value", k.alias("k"), "ts",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dense signals of every room, from one aggregation of events."""
    ev = events(spark, sf_dir)
    wide = ev.groupBy("room", "t").agg(
        F.avg("value").alias("rms"), F.count_if(F.col("type") == "error").cast("double").alias("eventLaughter"), F.count(F.lit(1)).cast("double").alias("dmDensity"),
        F.count_distinct("user_id").cast("double").alias("dmUniqueUsers"), F.max((F.col("type") == "signup").cast("double")).alias("sceneChange"),
    )
    full = timeline.dense(wide, ev, HOURS, *FROM_EVENTS)
    each = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(SIGNALS.index(s)).alias("ord"), F.col(s).alias("value")) for s in FROM_EVENTS])
    return full.select("room", "t", F.explode(each).alias("s")).select("room", "t", "s.signal", "s.ord", "s.value")


def spine(rows: DataFrame, n: int) -> DataFrame:
    return timeline.spine(rows, n)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat: a room each, a tick each turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("room"), F.col("turn").cast("int").alias("t"), F.col("turn").alias("line_no"), F.col("role").alias("user_id"), F.lit("chat").alias("type"), F.col("text").alias("content"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: each turn lasts two ticks."""
    turn = F.col("turn").cast("double")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("room"), F.col("turn").cast("int").alias("seg_idx"), turn.alias("start"), (turn + 2).alias("end"), "text", F.col("role").alias("speaker"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chat: a room for each source, five documents a tick."""
    return table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("room"), F.floor(F.col("doc_id") / 5).cast("int").alias("t"), F.col("doc_id").alias("line_no"), F.lit("").alias("user_id"), F.lit("chat").alias("type"), F.col("text").alias("content"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a daily signal of each return flag."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.ascii("l_returnflag").cast("long").alias("room"), day.alias("t")).agg(F.sum("l_extendedprice").alias("value"))
    return rows.select("room", "t", F.lit("rms").alias("signal"), F.lit(0).alias("ord"), "value")


def intervals_of_users(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Sessions of each user's events (gap over 6 h): (room, id, start, end, score, n) in hours; of one kind of event if given."""
    from pyspark.sql import Window

    ev = events(spark, sf_dir).where(F.lit(True) if kind is None else F.col("type") == kind)
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - START) / 3600
    rows = ev.select(F.col("user_id").alias("user"), "room", hours.alias("h"), "value", "k", "line_no")
    w = Window.partitionBy("user").orderBy("h", "line_no")
    runs = rows.withColumn("new", F.coalesce((F.col("h") - F.lag("h").over(w) > 6).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("user", "run").agg(F.min("h").alias("start"), F.max("h").alias("end"), F.round(F.sum("value"), 6).alias("score"), F.min("k").alias("k"), F.min("line_no").alias("id"))
    return out.select(F.col("user").alias("room"), "id", F.round("start", 6).alias("start"), F.round(F.col("end") + 0.5, 6).alias("end"), "score", "k")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals_of_users(spark, sf_dir, "purchase")
    return rows.select("room", "id", "start", "end", (1 + F.col("k") % 5).alias("quality"), F.lit(True).alias("worth"))
