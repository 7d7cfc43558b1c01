"""Projections and summaries for reports and clip metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words, and characters, that say nothing by themselves.
STOP_WORDS = (
    "什么", "怎么", "可以", "这个", "那个", "我们", "你们", "他们", "就是", "还是", "已经", "没有", "一个", "一下", "不是", "真的", "感觉", "东西", "现在", "因为", "所以", "但是", "然后", "如果",
    "知道", "喜欢", "谢谢", "主播", "直播", "链接", "多少", "时候", "大家", "老师", "兄弟", "姐妹", "宝宝", "朋友", "来了", "好的", "好吧", "哈哈", "哈哈哈", "呵呵", "嗯嗯", "对对", "是的", "收到",
    "关注", "点赞", "下单", "买买", "问一下", "我想", "有没有", "还有", "今天", "明天", "昨天", "这边", "那边", "这样", "那样", "一样", "非常", "特别", "比较", "应该", "可能", "不过", "而且", "或者",
    "以及", "对于", "关于", "里面", "外面", "上面", "下面", "一次", "两个", "几个", "好好", "一直", "开始", "觉得",
)
STOP_CHARS = "的了呢吗吧啊呀哦嗯哈是在有和就都也很还要会说我你他她它这那哪个不没"
CJK, LATIN, BRACKETS = r"[\x{4e00}-\x{9fff}]+", r"[A-Za-z][A-Za-z0-9_+-]{1,}", r"\[[^\]]{0,8}\]"


def chat_messages(chat: DataFrame) -> DataFrame:
    """Lines with text whose type is chat, or none."""
    return chat.where((F.trim("content") != "") & (F.col("type").isNull() | F.col("type").isin("", "chat", "danmaku")))


def ngram_tokens(text: Column) -> Column:
    """Tokens of a text without a dictionary: CJK runs up to 4 whole, longer ones as 2- and 3-grams; Latin words in lower case."""
    clean = F.regexp_replace(text, BRACKETS, " ")
    runs = F.regexp_extract_all(clean, F.lit(CJK), F.lit(0))
    grams = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3)))))
    return F.concat(cut, F.transform(F.regexp_extract_all(clean, F.lit(LATIN), F.lit(0)), F.lower))


def top_words(messages: DataFrame, limit: int = 20, by: str = "room") -> DataFrame:
    """(by, word, n): the most frequent words of messages (by, line_no, content); ties by first use."""
    stop = messages.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    each = messages.select(by, "line_no", F.posexplode(ngram_tokens(F.col("content"))).alias("pos", "word")).where(F.length("word") >= 2)
    said = each.where(F.col("word").rlike(f"[^{STOP_CHARS}]")).join(F.broadcast(stop), "word", "left_anti")
    counted = said.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select(by, "word", "n", "rank")


def reason_groups(dropped: DataFrame, limit: int = 200) -> DataFrame:
    """(reason, n, place, start, end, score): dropped clips by reason, up to `limit` shown of each."""
    full = dropped.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")))
    part = Window.partitionBy("reason")
    return full.withColumn("n", F.count(F.lit(1)).over(part)).withColumn("place", F.row_number().over(part.orderBy("start", "end"))).where(F.col("place") <= limit)


def safe_name(name: Column, length: int = 30) -> Column:
    """Letters, digits, spaces and _-+ of a name, up to a length."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N} _+-]", ""), 1, length)


def clip_path(folder: Column, start: Column, trigger: Column) -> Column:
    return F.concat(folder, F.lit("/clip_"), start.cast("int").cast("string"), F.lit("s_"), safe_name(trigger), F.lit(".mp4"))


def quoted(text: Column) -> Column:
    """Text as one word of a shell command."""
    plain = text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def cut_command(source: Column, start: Column, end: Column, rank: Column, trigger: Column) -> Column:
    """The command that would cut a clip; nothing is run."""
    a = F.greatest(F.lit(0.0), start)
    d = F.greatest(F.lit(0.1), F.greatest(a, end) - a)
    name = F.coalesce(F.nullif(safe_name(trigger), F.lit("")), F.concat(F.lit("clip"), rank.cast("string")))
    out = F.format_string("highlight_%02d_%ds_%s.mp4", rank, a.cast("int"), name)
    return F.format_string("ffmpeg -hide_banner -ss %.3f -i %s -t %.3f -c copy -y %s", a, quoted(F.coalesce(source, F.lit("source.mp4"))), d, quoted(out))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds cut off."""
    s = F.floor(seconds)
    ms = F.floor((seconds - s) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)), ms)


def clock_time(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour."""
    s = F.greatest(F.lit(0), F.bround(F.coalesce(F.nanvl(seconds, F.lit(0.0)), F.lit(0.0))).cast("long"))
    h, m, x = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, x)).otherwise(F.format_string("%02d:%02d", m, x))


def file_size(size: Column) -> Column:
    mb, kb = F.format_string("%.1f MB", size / 1048576.0), F.format_string("%.1f KB", size / 1024.0)
    return F.when(size >= 1048576, mb).when(size >= 1024, kb).otherwise(F.format_string("%d B", size))


def chat_stats(chat: DataFrame) -> DataFrame:
    """(room, messages, chats, users, level): size of a room's chat, with a level from 0 to 3."""
    plain = (F.trim("content") != "") & (F.col("type").isNull() | F.col("type").isin("", "chat", "danmaku"))
    out = chat.groupBy("room").agg(F.count(F.lit(1)).alias("messages"), F.count_if(plain).alias("chats"), F.count_distinct(F.nullif(F.col("user_id").cast("string"), F.lit(""))).alias("users"))
    return out.withColumn("level", F.when(F.col("chats") == 0, 0).when(F.col("chats") < 100, 1).when(F.col("chats") < 1000, 2).otherwise(3))


def last_messages(chat: DataFrame, k: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("t"), F.desc("line_no")))
    return chat.withColumn("place", place).where(F.col("place") <= k)


def transcript_summary(asr: DataFrame, excerpt: int = 1500, segments: int = 200) -> DataFrame:
    """(room, segments, speech, text): of the first segments of a room, their seconds and an excerpt."""
    place = F.row_number().over(Window.partitionBy("room").orderBy("seg_idx"))
    kept = asr.withColumn("place", place).where(F.col("place") <= segments)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ")
    return kept.groupBy("room").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("speech"), F.substring(text, 1, excerpt).alias("text"))


def top_candidates(candidates: DataFrame, k: int = 50) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("score"), "start", "id"))
    return candidates.withColumn("place", place).where(F.col("place") <= k)


def reasons(given: Column, trigger: Column, breakdown: Column) -> Column:
    """Given reasons, else the trigger and the names of positive parts, largest first."""
    parts = F.transform(F.array_sort(F.transform(F.map_entries(breakdown), lambda e: F.struct((-F.abs(e["value"])).alias("by"), e["key"].alias("key"), e["value"].alias("value")))), lambda x: F.when(x["value"] > 0, x["key"]))
    derived = F.array_distinct(F.filter(F.concat(F.array(F.nullif(trigger, F.lit(""))), F.coalesce(parts, F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(derived)


def suggested_action(risks: Column, drop_reasons: Column) -> Column:
    return F.when(F.size(drop_reasons) > 0, "drop").when(F.size(risks) > 0, "review").otherwise("keep")


def clip_metadata(clips: DataFrame) -> DataFrame:
    """One document a clip (room, id, start, end, duration, score, confidence, trigger, tags, risks): defaults, guards, rounding."""
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    start = number("start")
    end = F.greatest(start, number("end"))
    duration = F.when(number("duration") > 0, number("duration")).otherwise(end - start)
    none = F.array().cast("array<string>")
    return clips.select(
        "room", "id", F.round(start, 3).alias("start"), F.round(end, 3).alias("end"), F.round(duration, 3).alias("duration"), F.round(number("score"), 4).alias("score"),
        F.round(F.nanvl(F.col("confidence").cast("double"), F.lit(None).cast("double")), 4).alias("confidence"), "trigger", F.coalesce("tags", none).alias("tags"), F.coalesce("risks", none).alias("risks"),
        suggested_action(F.coalesce("risks", none), none).alias("action"),
    )


def clip_subtitles(cues: DataFrame, clips: DataFrame, width: float = 64.0) -> DataFrame:
    """(room, id, number, from, till, text): cues (room, start, end, text) that touch each clip, cut to it, from 0.

    Cues and clips meet in shared buckets of time, and a pair counts in the first of them only.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    spoken = cues.select("room", F.col("start").alias("cs"), F.greatest("start", "end").alias("ce"), "text").withColumn("bucket", buckets("cs", "ce"))
    dealt = clips.where("start <= end").select("room", "id", "start", "end").withColumn("bucket", buckets("start", "end"))
    first = F.floor(F.greatest("cs", "start") / width)
    joined = spoken.join(dealt, ["room", "bucket"]).where((F.col("ce") >= F.col("start")) & (F.col("cs") <= F.col("end")) & (F.col("bucket") == first))
    place = F.row_number().over(Window.partitionBy("room", "id").orderBy("cs", "ce"))
    return joined.select("room", "id", place.alias("number"), F.greatest(F.lit(0.0), F.col("cs") - F.col("start")).alias("from"), F.least(F.col("end") - F.col("start"), F.col("ce") - F.col("start")).alias("till"), "text")


def subtitle_text(subtitles: DataFrame) -> DataFrame:
    """(room, id, srt): numbered cues as one subtitle text a clip."""
    cue = F.concat(F.col("number").cast("string"), F.lit("\n"), srt_time(F.col("from")), F.lit(" --> "), srt_time(F.col("till")), F.lit("\n"), F.col("text"))
    return subtitles.groupBy("room", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("srt"))


def timing_summary(runs: DataFrame) -> DataFrame:
    """(mode, least, middle, most) of measured seconds."""
    return runs.groupBy("mode").agg(F.min("seconds").alias("least"), F.median("seconds").alias("middle"), F.max("seconds").alias("most"))


def signal_order(stats: DataFrame, top: int = 5, limit: int = 10) -> DataFrame:
    """(room, place, signal, share) of the signals (room, signal, ord, weight, contribution) that a report shows.

    The `top` weighted ones come first, then all by contribution; share is the width of a bar, from 2 to 100.
    """
    rank = F.row_number().over(Window.partitionBy("room").orderBy(F.desc(F.col("weight") > 0), F.desc("contribution"), "ord"))
    chosen = stats.withColumn("first", F.when((rank <= top) & (F.col("weight") > 0), rank))
    place = F.row_number().over(Window.partitionBy("room").orderBy(F.col("first").asc_nulls_last(), F.desc("contribution"), "ord"))
    shown = chosen.withColumn("place", place).where(F.col("place") <= limit)
    most = F.max("contribution").over(Window.partitionBy("room"))
    return shown.withColumn("share", F.greatest(F.lit(2.0), F.col("contribution") / F.when(most > 0, most).otherwise(1.0) * 100)).select("room", "place", "signal", "share")


def baseline(clips: DataFrame, dropped: DataFrame, adjusted: DataFrame, signals: DataFrame, alignment: DataFrame) -> DataFrame:
    """(level, room, kind, name, n, least, mean, most): what came out of every room, and of all, in one grouping of all facts.

    Facts are durations of clips (room, start, end), reasons of dropped and adjusted ones (room, reason), lengths of signals (room, signal, t) and changes by
    alignment (room, how). level says what a row sums up: name (of a room), room, name of all, or all; room and name are null where they are summed up.
    """
    fact = lambda rows, kind, name, value: rows.select("room", F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    none = F.lit(None)
    lengths = signals.groupBy("room", "signal").agg((F.max("t") + 1).alias("ticks"))
    facts = fact(clips, "clip", F.lit("duration"), F.col("end") - F.col("start"))
    reason = F.coalesce("reason", F.lit("unknown"))
    for more in (fact(dropped, "dropped", reason, none), fact(adjusted, "adjusted", reason, none), fact(lengths, "signal", F.col("signal"), F.col("ticks")), fact(alignment, "aligned", F.col("how"), none)):
        facts = facts.unionByName(more)
    sets = [["room", "kind", "name"], ["room", "kind"], ["kind", "name"], ["kind"]]
    # names of rows that sum up are null, so a fact has none that is null itself
    facts = facts.fillna("", ["name"])
    out = facts.groupingSets([[F.col(c) for c in some] for some in sets], "room", "kind", "name").agg(
        F.grouping("room").alias("all_rooms"), F.grouping("name").alias("all_names"), F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.round(F.avg("value"), 3).alias("mean"), F.max("value").alias("most")
    )
    level = F.when(F.col("all_rooms") + F.col("all_names") == 2, "all").when(F.col("all_rooms") == 1, "name of all").when(F.col("all_names") == 1, "room").otherwise("name")
    return out.select(level.alias("level"), "room", "kind", "name", "n", "least", "mean", "most")
