"""All signals of chat and transcripts, and what is said about them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidepeak.functions.settle import settle
from tidepeak.functions.windows import sliding_distinct
from tidepeak.operators import text, timeline
from tidepeak.schema import SIGNALS


@dataclass(frozen=True)
class TextSettings:
    phrases: tuple[str, ...] = ()
    radius: int = 5
    utr_radius: int = 30
    utr_threshold: float = 0.3
    calibrate: bool = True
    sentiment: str = "rules"
    model: Callable[[Column], Column] | None = field(default=None, compare=False)
    tokenizer: Callable[[Column], Column] = field(default=text.split_words, compare=False)
    positive: tuple[str, ...] = text.POSITIVE
    negative: tuple[str, ...] = text.NEGATIVE
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: text.KEYWORDS, compare=False)
    #: Messages of a tick that count for its entropy, in order of arrival, and tokens of it.
    entropy_cap: int = 200
    entropy_top: int = 50


def signal_name(category: str) -> str:
    return f"keyword{category[0].upper()}{category[1:]}"


#: Kinds of facts: of a message, of one outside of the recording, and of its tokens, normalised form and user.
MESSAGE, OUTSIDE, TOKEN, SAID, USER = "n", "x", "w", "m", "u"


def facts(chat: DataFrame, n: int, settings: TextSettings = TextSettings(), counters: Observation | None = None) -> DataFrame:
    """(room, t, kind, item, c, early, mood, hits): all that the signals need to know of chat, from one scan and one aggregation by room, tick, kind and item.

    c counts occurrences, early those among the first messages of a tick; mood and hits (one for each kind of rate) are sums over
    messages. Messages outside of the recording are counted at tick -1. counters gets the numbers of messages, and of those
    skipped and blank, while the same job runs.
    """
    arrived = F.row_number().over(Window.partitionBy("room", "t").orderBy("line_no"))
    inside = F.col("t").between(0, n - 1)
    content = F.coalesce("content", F.lit(""))
    lower = F.lower(content)
    rates = [content.rlike(text.QUESTION), content.rlike(text.EXCLAMATION), content.rlike(text.EMOJI), *[text.holds_any(lower, [p.lower() for p in words]) for words in settings.keywords.values()]]
    mood = text.mood_of(content, settings.sentiment, settings.model, settings.tokenizer, positive=settings.positive, negative=settings.negative)
    plain = F.regexp_replace(lower, r"\s+", "")
    rows = chat
    if counters is not None:
        rows = rows.observe(counters, F.count(F.lit(1)).alias("messages"), F.count_if(~inside).alias("skipped"), F.count_if(F.trim(content) == "").alias("blank"))
    rows = rows.withColumn("arrived", arrived)
    none = F.lit(None).cast("string")
    # moods and hits are fields of the message's own item: columns beside an explode are made anew for each token
    no_mood, no_hits = F.lit(None).cast("double"), F.lit(None).cast("array<bigint>")
    item = lambda kind, name, mood=no_mood, hits=no_hits: F.struct(F.lit(kind).alias("kind"), name.alias("item"), mood.alias("mood"), hits.alias("hits"))
    found_hits = F.array(*[F.coalesce(hit, F.lit(False)).cast("long") for hit in rates])
    tokens = F.filter(F.split(F.trim(F.regexp_replace(content, r"\s+", " ")), " "), lambda w: w != "")
    said = F.filter(F.array(plain), lambda p: p != "")
    parts = F.concat(
        F.array(item(MESSAGE, none, mood.cast("double"), found_hits), item(USER, text.user_hash(F.col("user_id")))),
        F.transform(tokens, lambda w: item(TOKEN, w)),
        F.transform(said, lambda p: item(SAID, F.md5(p))),  # digests move, not messages
    )
    kept = F.when(inside, parts).otherwise(F.array(item(OUTSIDE, none)))
    each = rows.select("room", F.when(inside, F.col("t")).otherwise(-1).alias("t"), (F.col("arrived") <= settings.entropy_cap).cast("long").alias("early"), F.explode(kept).alias("p"))
    sums = [F.sum(F.coalesce(F.get("p.hits", F.lit(i)), F.lit(0))).alias(f"h{i}") for i in range(len(rates))]
    found = each.groupBy("room", "t", F.col("p.kind").alias("kind"), F.col("p.item").alias("item")).agg(F.count(F.lit(1)).alias("c"), F.sum("early").alias("early"), F.sum("p.mood").alias("mood"), *sums)
    return found.select("room", "t", "kind", "item", "c", "early", "mood", F.array(*[f"h{i}" for i in range(len(rates))]).alias("hits"))


def signals(chat: DataFrame, asr: DataFrame, n: int, settings: TextSettings = TextSettings(), topics: DataFrame | None = None, counters: Observation | None = None) -> DataFrame:
    """Signals (room, t, signal, ord, value) of ticks 0 to n - 1 of every room of chat (room, t, line_no, content, user_id, type) and transcripts.

    topics are changes (room, t, topicChange); without them there is no such signal. Chat is read once.
    """
    return signals_of(settle(facts(chat, n, settings, counters)), asr, n, settings, topics)


def signals_of(known: DataFrame, asr: DataFrame, n: int, settings: TextSettings = TextSettings(), topics: DataFrame | None = None) -> DataFrame:
    """signals() of facts() that are stored."""
    rooms = known.select("room").unionByName(asr.select("room"))
    spine = timeline.spine(rooms, n)
    inside = known.where("t >= 0")
    # ── each tick by itself ──
    tick = inside.where(F.col("kind") == MESSAGE).select("room", "t", "c", "mood", "hits")
    users = inside.where(F.col("kind") == USER).groupBy("room", "t").agg(F.count(F.lit(1)).alias("users"))
    # ── windows over items ──
    words = inside.where(F.col("kind") == TOKEN).select("room", "t", "item", "c")
    said = inside.where(F.col("kind") == SAID).select("room", "t", "item", "c")
    utr = sliding_distinct(words, spine, settings.utr_radius, "w_n", "w_distinct")
    repeats = sliding_distinct(said, spine, settings.radius, "m_n", "m_distinct")
    early = inside.where((F.col("kind") == TOKEN) & (F.col("early") > 0)).select("room", "t", "item", F.col("early").alias("c"))
    entropy = text.entropy_of(early, settings.radius, settings.entropy_top)
    # ── all of a tick beside each other, and windows over ticks ──
    wide = spine
    for part in (tick, users, utr, repeats, entropy):
        wide = wide.join(part, ["room", "t"], "left")
    around = Window.partitionBy("room").orderBy("t").rangeBetween(-settings.radius, settings.radius)
    total = F.sum(F.coalesce("c", F.lit(0))).over(around)
    rate = lambda i: F.coalesce(F.try_divide(F.sum(F.coalesce(F.get("hits", F.lit(i)), F.lit(0))).over(around), total), F.lit(0.0))
    kinds = list(settings.keywords)
    wide = wide.select(
        "room", "t", F.coalesce("c", F.lit(0)).alias("dmDensity"), F.coalesce("dmEntropy", F.lit(0.0)).alias("dmEntropy"), F.coalesce(F.try_divide("mood", "c"), F.lit(0.0)).alias("dmSentiment"), F.coalesce("users", F.lit(0)).alias("dmUniqueUsers"),
        F.when(F.coalesce("w_n", F.lit(0)) == 0, 1.0).otherwise(F.col("w_distinct") / F.col("w_n")).alias("dmUtr"),
        F.when(F.coalesce("m_n", F.lit(0)) == 0, 0.0).otherwise((F.col("m_n") - F.col("m_distinct")) / F.col("m_n")).alias("dmRepeatRate"),
        *[rate(i).alias(name) for i, name in enumerate(("dmQuestionRate", "dmExclamationRate", "dmEmojiRate", *map(signal_name, kinds)))],
    )
    # ── what the transcripts say ──
    spoken = text.covered_ticks(asr, n, False).groupBy("room", "t").agg(*[F.max(text.holds_any(F.lower("text"), [p.lower() for p in words]).cast("double")).alias(f"spoken{i}") for i, words in enumerate(settings.keywords.values())])
    wide = settle(wide.join(spoken, ["room", "t"], "left")) if settings.calibrate else wide.join(spoken, ["room", "t"], "left")
    if settings.calibrate:
        limits = text.diversity_threshold(wide.select("room", "t", "dmUtr"), wide.where("dmDensity > 0").select("room", "t", "dmDensity"), settings.utr_threshold)
        wide = wide.join(limits, "room")
    else:
        wide = wide.withColumn("threshold", F.lit(settings.utr_threshold))
    wide = wide.join(text.asr_keyword(asr, spine, list(settings.phrases), n), ["room", "t"]).join(text.speaker_change(asr, spine, n), ["room", "t"])
    if topics is not None:
        wide = wide.join(text.topic_signal(topics, spine), ["room", "t"])
    factor = F.when((F.col("dmUtr") > 0) & (F.col("threshold") > 0), F.least(F.lit(1.0), F.col("dmUtr") / F.col("threshold"))).otherwise(1.0)
    wide = wide.withColumn("dmDensity", F.col("dmDensity").cast("double") * factor)
    by_time = Window.partitionBy("room").orderBy("t")
    wide = wide.withColumn("dmAcceleration", F.coalesce(F.lead("dmDensity").over(by_time) - 2 * F.col("dmDensity") + F.lag("dmDensity").over(by_time), F.lit(0.0)))
    for i, name in enumerate(map(signal_name, kinds)):
        wide = wide.withColumn(name, F.least(F.lit(1.0), 0.6 * F.col(name) + 0.4 * F.coalesce(f"spoken{i}", F.lit(0.0))))
    names = [c for c in SIGNALS if c in wide.columns]
    long = F.array(*[F.struct(F.lit(name).alias("signal"), F.lit(SIGNALS.index(name)).alias("ord"), F.col(name).cast("double").alias("value")) for name in names])
    return wide.select("room", "t", F.inline(long))


def counted(known: DataFrame) -> DataFrame:
    """(room, messages, skipped) of stored facts()."""
    message, outside = F.col("kind") == MESSAGE, F.col("kind") == OUTSIDE
    return known.where(message | outside).groupBy("room").agg(F.sum("c").alias("messages"), F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("skipped"))


def stats(chat: DataFrame, signals: DataFrame, transcripts: DataFrame, n: int, settings: TextSettings = TextSettings()) -> DataFrame:
    """(room, status, messages, skipped, asr_status, asr_degraded, asr_segments, features, utr_samples, utr_source, keyword_max) of stored signals.

    transcripts are reports (room, status, degraded, segments); a room without one has none. A room whose signals are all 0 is empty.
    """
    said = chat.groupBy("room").agg(F.count(F.lit(1)).alias("messages"), F.count_if(~F.col("t").between(0, n - 1)).alias("skipped"))
    category = F.col("signal").startswith("keyword")
    found = signals.groupBy("room", "signal").agg(F.max(F.abs("value")).alias("most"))
    per_room = found.groupBy("room").agg(F.count_if(F.col("most") > 0).alias("features"), F.map_from_entries(F.array_sort(F.collect_list(F.when(category, F.struct("signal", F.round("most", 4).alias("most")))))).alias("keyword_max"))
    busy = chat.where(F.col("t").between(0, n - 1)).select("room", "t").distinct()
    samples = signals.where("signal = 'dmUtr' AND value > 0").join(busy, ["room", "t"], "left_semi").groupBy("room").agg(F.count(F.lit(1)).alias("utr_samples"))
    heard = transcripts.select("room", F.col("status").alias("asr_status"), F.col("degraded").alias("asr_degraded"), F.col("segments").alias("asr_segments"))
    out = per_room.join(said, "room", "left").join(samples, "room", "left").join(heard, "room", "left").fillna(0, ["messages", "skipped", "utr_samples", "asr_segments"])
    source = F.when(F.lit(settings.calibrate) & (F.col("utr_samples") >= 60), "calibrated").otherwise("configured")
    return out.select(
        "room", F.when(F.col("features") > 0, "ok").otherwise("empty").alias("status"), "messages", "skipped", F.coalesce("asr_status", F.lit("missing")).alias("asr_status"), F.coalesce("asr_degraded", F.lit(True)).alias("asr_degraded"),
        "asr_segments", "features", "utr_samples", source.alias("utr_source"), "keyword_max",
    )
