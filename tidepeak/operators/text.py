"""Signals from chat lines and transcripts: one row per (room, t).

Chat is (room, t, line_no, content, user_id, type); transcripts are (room, seg_idx, start, end, text, speaker).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.functions.windows import sliding_distinct
from tidepeak.schema import room_type

#: Words of the rule-based mood.
POSITIVE = ("哈哈", "哈哈哈", "好", "nice", "牛", "牛批", "赞", "喜欢", "漂亮", "精彩", "笑", "笑死", "乐", "666", "绝了", "感动", "爱了", "厉害", "优秀", "谢谢", "开心", "可爱", "好笑")
NEGATIVE = ("无语", "差", "垃圾", "退", "骗", "恶心", "翻车", "下头", "难受", "破防", "哭了", "失望", "生气", "离谱", "别买")
#: Phrases of the six keyword categories.
KEYWORDS = {
    "highEnergy": ("卧槽", "牛批", "666", "离谱", "绝了", "太强了", "无敌", "牛逼", "nb", "秀", "天秀", "带飞", "起飞", "芜湖", "炸裂", "封神", "名场面"),
    "funny": ("笑死", "哈哈哈哈", "蚌埠住了", "没绷住", "乐", "太搞笑了", "搞笑", "哈哈哈", "笑不活了", "笑拉了", "红红火火", "整活", "绷不住", "节目效果", "不是吧"),
    "controversy": ("无语", "下头", "恶心", "退钱", "翻车", "别买", "什么玩意", "就这", "退了", "开喷", "剧本", "假的吧"),
    "interactive": ("抽我", "福袋", "左上角", "点关注", "加粉丝团", "抽奖", "中了", "抽到我", "扣1", "来了", "真的假的", "怎么说", "有没有"),
    "emotional": ("哭了", "感动", "破防", "泪目", "暖心了", "心疼", "抱抱", "加油", "谢谢老板", "辛苦了"),
    "shopping": ("上链接", "上车", "库存", "最后一批", "拍一号", "开抢", "优惠券", "满减", "秒杀", "下单", "福利价", "到手价", "别犹豫", "限时", "补货"),
}
QUESTION, EXCLAMATION = r"[?\x{FF1F}]", r"[!\x{FF01}]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]|\[[^\[\]]{1,8}\]"


def user_hash(user: Column, length: int = 16) -> Column:
    """Short digest of a user id; a missing id is the empty one."""
    return F.substring(F.sha2(F.coalesce(user.cast("string"), F.lit("")), 256), 1, length)


def density(chat: DataFrame) -> DataFrame:
    """Messages of each tick, of any type."""
    return chat.groupBy("room", "t").agg(F.count(F.lit(1)).alias("dmDensity"))


def unique_users(chat: DataFrame) -> DataFrame:
    return chat.groupBy("room", "t").agg(F.count_distinct(user_hash(F.col("user_id"))).alias("dmUniqueUsers"))


def tokens(chat: DataFrame) -> DataFrame:
    """(room, t, item) of every whitespace-separated token."""
    return chat.select("room", "t", F.explode(F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " ")).alias("item")).where("item <> ''")


def token_diversity(chat: DataFrame, spine: DataFrame, radius: int = 30) -> DataFrame:
    """dmUtr: different tokens by tokens around each tick; 1 where there are none."""
    counts = sliding_distinct(tokens(chat), spine, radius)
    return counts.select("room", "t", F.when(F.col("n") == 0, 1.0).otherwise(F.col("n_distinct") / F.col("n")).alias("dmUtr"))


def diversity_threshold(utr: DataFrame, density: DataFrame, configured: float = 0.3, share: float = 0.2, least: int = 60, low: float = 0.15, high: float = 0.6) -> DataFrame:
    """(room, threshold): a quantile of the diversity of ticks with messages, within limits; the configured one for few ticks."""
    busy = utr.join(density, ["room", "t"]).where("dmUtr > 0")
    found = busy.groupBy("room").agg(F.count(F.lit(1)).alias("k"), F.percentile("dmUtr", F.lit(share)).alias("q"))
    chosen = F.when(F.col("k") < least, F.lit(configured)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("q"))))
    return utr.select("room").distinct().join(found, "room", "left").select("room", F.coalesce(chosen, F.lit(configured)).alias("threshold"))


def adjusted_density(density: DataFrame, utr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Density, less where few different tokens make it up."""
    joined = utr.join(thresholds, "room").join(density, ["room", "t"], "left")
    raw = F.coalesce(F.col("dmDensity"), F.lit(0)).cast("double")
    factor = F.when((F.col("dmUtr") > 0) & (F.col("threshold") > 0), F.least(F.lit(1.0), F.col("dmUtr") / F.col("threshold"))).otherwise(1.0)
    return joined.select("room", "t", (raw * factor).alias("dmDensity"))


def acceleration(series: DataFrame, value: str = "value", to: str = "dmAcceleration") -> DataFrame:
    """Second difference; 0 at both ends."""
    w = Window.partitionBy("room").orderBy("t")
    return series.select("room", "t", F.coalesce(F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w), F.lit(0.0)).alias(to))


def entropy(chat: DataFrame, spine: DataFrame, radius: int = 5, cap: int = 200, top: int = 50) -> DataFrame:
    """dmEntropy of the tokens around each tick: `cap` messages a tick in order of arrival, the `top` most frequent tokens.

    Tokens are counted per tick before they are spread to the ticks around.
    """
    arrived = Window.partitionBy("room", "t").orderBy("line_no")
    kept = chat.withColumn("at", F.row_number().over(arrived)).where(F.col("at") <= cap)
    counted = tokens(kept).groupBy("room", "t", "item").agg(F.count(F.lit(1)).alias("c"))
    found = entropy_of(counted, radius, top)
    return spine.join(found, ["room", "t"], "left").select("room", "t", F.coalesce("dmEntropy", F.lit(0.0)).alias("dmEntropy"))


def entropy_of(counted: DataFrame, radius: int = 5, top: int = 50) -> DataFrame:
    """(room, t, dmEntropy) of tokens that are counted by tick (room, t, item, c), for ticks near any.

    An item's count around a tick changes only where one of its ticks enters or leaves, and holds from there to the next
    change; what is spread over ticks is these runs, not each (tick, token) by the radius.
    """
    steps = counted.select("room", "item", F.inline(F.array(F.struct((F.col("t") - radius).alias("t"), F.col("c")), F.struct((F.col("t") + radius + 1).alias("t"), (-F.col("c")).alias("c")))))
    steps = steps.groupBy("room", "item", "t").agg(F.sum("c").alias("d"))
    w = Window.partitionBy("room", "item").orderBy("t")
    runs = steps.withColumn("c", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.lead("t").over(w)).where("c > 0")
    spread = runs.select("room", "item", "c", F.explode(F.sequence("t", F.col("upto") - 1)).alias("t"))
    # total and place share one order, so that a task sorts its tokens once
    tick = Window.partitionBy("room", "t").orderBy(F.desc("c"), "item")
    whole = tick.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = spread.withColumns({"total": F.sum("c").over(whole), "place": F.row_number().over(tick)}).where(F.col("place") <= top)
    p = F.col("c") / F.col("total")
    return ranked.groupBy("room", "t").agg((-F.sum(p * F.log2(p))).alias("dmEntropy"))


def mood(words: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """0.5, -0.5 or 0 by which list more words are of."""
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return F.signum((hits(positive) - hits(negative)).cast("double")) * 0.5


def split_words(text: Column) -> Column:
    """Words apart by white space: the tokenizer unless another one is given."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def mood_of(text: Column, mode: str = "rules", model: Callable[[Column], Column] | None = None, tokenizer: Callable[[Column], Column] = split_words, length: int = 512, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Mood of a text from -1 to 1: by rules; by the model where the rules are neutral (hybrid); or by the model (hf).

    The model maps the first `length` characters to a number; where it has none, or is not given, the rules hold.
    """
    if mode not in ("rules", "hybrid", "hf"):
        raise ValueError("mode must be one of rules, hybrid, hf")
    rules = mood(tokenizer(text), positive, negative)
    if mode == "rules" or model is None:
        return rules
    judged = F.coalesce(model(F.substring(text, 1, length)), rules)
    return F.when(rules != 0, rules).otherwise(judged) if mode == "hybrid" else judged


def sentiment(chat: DataFrame, spine: DataFrame, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE, mode: str = "rules", model: Callable[[Column], Column] | None = None, tokenizer: Callable[[Column], Column] = split_words) -> DataFrame:
    """dmSentiment: mean mood of each tick's messages; 0 where there are none."""
    each = mood_of(F.col("content"), mode, model, tokenizer, positive=positive, negative=negative)
    means = chat.groupBy("room", "t").agg(F.avg(each).alias("dmSentiment"))
    return spine.join(means, ["room", "t"], "left").select("room", "t", F.coalesce("dmSentiment", F.lit(0.0)).alias("dmSentiment"))


def repeat_rate(chat: DataFrame, spine: DataFrame, radius: int = 5) -> DataFrame:
    """dmRepeatRate: share of messages around a tick that repeat another, white space and case aside; blank ones do not count."""
    items = chat.select("room", "t", F.regexp_replace(F.lower("content"), r"\s+", "").alias("item")).where("item <> ''")
    # digests move, not messages
    counts = sliding_distinct(items.withColumn("item", F.unhex(F.md5("item"))), spine, radius)
    return counts.select("room", "t", F.when(F.col("n") == 0, 0.0).otherwise((F.col("n") - F.col("n_distinct")) / F.col("n")).alias("dmRepeatRate"))


def message_rate(chat: DataFrame, spine: DataFrame, hit: Column, to: str, radius: int = 5) -> DataFrame:
    """Share of the messages around each tick for which `hit` holds; 0 where there are none."""
    per_tick = chat.groupBy("room", "t").agg(F.count_if(hit).alias("h"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("room").orderBy("t").rangeBetween(-radius, radius)
    full = spine.join(per_tick, ["room", "t"], "left")
    around = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    return full.select("room", "t", F.coalesce(F.try_divide(around("h"), around("n")), F.lit(0.0)).alias(to))


def question_rate(chat: DataFrame, spine: DataFrame, radius: int = 5) -> DataFrame:
    return message_rate(chat, spine, F.col("content").rlike(QUESTION), "dmQuestionRate", radius)


def exclamation_rate(chat: DataFrame, spine: DataFrame, radius: int = 5) -> DataFrame:
    return message_rate(chat, spine, F.col("content").rlike(EXCLAMATION), "dmExclamationRate", radius)


def emoji_rate(chat: DataFrame, spine: DataFrame, radius: int = 5) -> DataFrame:
    return message_rate(chat, spine, F.col("content").rlike(EMOJI), "dmEmojiRate", radius)


def category(name: Column) -> Column:
    """A category's own name, whatever its case and punctuation; null if it is none."""
    plain = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return F.coalesce(*[F.when(plain == c.lower(), F.lit(c)) for c in KEYWORDS])


def holds_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return F.coalesce(found, F.lit(False))


def covered_ticks(segments: DataFrame, n: int, exclusive: bool) -> DataFrame:
    """Segments exploded to the ticks that they cover; if exclusive, an end beyond the recording leaves out its last tick."""
    end = F.ceil("end").cast("int")
    end = F.when(end >= n, n - 1).otherwise(end) if exclusive else F.least(end, F.lit(n))
    first, last = F.greatest(F.col("start").cast("int"), F.lit(0)), end - 1
    return segments.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("t", F.explode(F.sequence("first", "last"))).drop("first", "last")


def keyword_rate(chat: DataFrame, asr: DataFrame, spine: DataFrame, phrases: list[str], n: int, to: str, radius: int = 5) -> DataFrame:
    """0.6 of the share of messages around a tick with a phrase, and 0.4 if the transcript has one there; 1 at most."""
    chat_part = message_rate(chat, spine, holds_any(F.lower("content"), [p.lower() for p in phrases]), "rate", radius)
    spoken = asr.where(holds_any(F.lower("text"), [p.lower() for p in phrases]))
    hit = covered_ticks(spoken, n, False).select("room", "t", F.lit(1.0).alias("hit")).distinct()
    both = chat_part.join(hit, ["room", "t"], "left")
    return both.select("room", "t", F.least(F.lit(1.0), 0.6 * F.col("rate") + 0.4 * F.coalesce("hit", F.lit(0.0))).alias(to))


def asr_keyword(asr: DataFrame, spine: DataFrame, phrases: list[str], n: int, vectors: list[list[float]] | None = None, threshold: float = 0.7) -> DataFrame:
    """1 where the transcript has a phrase, by exact case; the last tick is never set.

    With phrase vectors, a segment (column vector) without a phrase counts if it is similar enough to one of them.
    """
    found = holds_any(F.col("text"), phrases)
    if vectors:
        keys = F.array(*[F.array(*map(F.lit, v)) for v in vectors])
        found = found | F.coalesce(F.exists(keys, lambda k: cosine(F.col("vector"), k) > threshold), F.lit(False))
    hit = covered_ticks(asr.where(found), n, True).select("room", "t", F.lit(1.0).alias("hit")).distinct()
    return spine.join(hit, ["room", "t"], "left").select("room", "t", F.coalesce("hit", F.lit(0.0)).alias("asrKeyword"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-10) * (F.sqrt(dot(b, b)) + 1e-10))


def fuzzy_match(vectors: DataFrame, keywords: list[tuple[int, list[float]]], threshold: float = 0.7) -> DataFrame:
    """Vectors (vec_id, embedding) with their most similar keyword (key_id, vector) by cosine, over the threshold; none without keywords."""
    if not keywords:
        return vectors.select("vec_id", F.lit(None).cast("long").alias("key_id"), F.lit(None).cast("double").alias("similarity")).where(F.lit(False))
    known = F.array(*[F.struct(F.lit(k).alias("key_id"), F.array(*map(F.lit, v)).alias("key")) for k, v in keywords])
    best = F.array_max(F.transform(known, lambda k: F.struct(cosine(F.col("embedding"), k["key"]).alias("similarity"), (-k["key_id"]).alias("order"))))
    found = vectors.select("vec_id", best.alias("b")).where(F.col("b.similarity") > threshold)
    return found.select("vec_id", (-F.col("b.order")).cast("long").alias("key_id"), "b.similarity")


def speaker_change(asr: DataFrame, spine: DataFrame, n: int) -> DataFrame:
    """1 where two segments that share a tick, in order, have different speakers."""
    w = Window.partitionBy("room", "t").orderBy("seg_idx")
    turns = covered_ticks(asr.where(F.col("speaker").isNotNull()), n, True).withColumn("before", F.lag("speaker").over(w))
    hit = turns.where("before <> speaker").select("room", "t", F.lit(1.0).alias("hit")).distinct()
    return spine.join(hit, ["room", "t"], "left").select("room", "t", F.coalesce("hit", F.lit(0.0)).alias("speakerChange"))


def nearest_means(x: np.ndarray, k: int, seed: int, rounds: int = 20, tries: int = 10) -> np.ndarray:
    """Labels of k-means on the rows of x: the best of some starts, whose centres are drawn far apart."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(tries):
        centres = x[rng.integers(len(x))][None]
        while len(centres) < k:
            far = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.concatenate([centres, x[rng.choice(len(x), p=far / far.sum())][None] if far.sum() > 0 else centres[:1]])
        for _ in range(rounds):
            distance = ((x[:, None] - centres) ** 2).sum(2)
            labels = distance.argmin(1)
            moved = np.stack([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.array_equal(moved, centres):
                break
            centres = moved
        cost = float(distance.min(1).sum())
        if cost < best[0] - 1e-12:
            best = cost, labels
    return best[1]


def topic_change(embedded: DataFrame, window: int = 30, clusters: int = 5, seed: int = 42) -> DataFrame:
    """(room, t, topicChange) at the start of each window of vectors (room, t, features): 1 where its cluster is another than that of the window before.

    Windows are means of all components. Each room's windows are clustered by themselves, by k-means with up to `clusters`
    centres but no more than half the windows, at least two; a room of one window has no change.
    """
    parts = embedded.select("room", F.floor(F.col("t") / window).cast("int").alias("w"), F.posexplode("features").alias("i", "x"))
    means = parts.groupBy("room", "w", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = means.groupBy("room", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("w")
        change = np.zeros(len(rows))
        if len(rows) >= 2:
            width = max(map(len, rows["v"]))
            x = np.stack([np.pad(np.asarray(v, float), (0, width - len(v))) for v in rows["v"]])
            labels = nearest_means(x, max(2, min(clusters, len(rows) // 2)), seed)
            change[1:] = labels[1:] != labels[:-1]
        return pd.DataFrame({"room": rows["room"], "t": rows["w"] * window, "topicChange": change})

    # one group a room: a vector for each window of a recording
    return pooled.groupBy("room").applyInPandas(run, f"room {room_type(embedded)}, t int, topicChange double")


def topic_signal(changes: DataFrame, spine: DataFrame, window: int = 30) -> DataFrame:
    """topicChange for every tick of spine: 1 at the first tick of a window whose topic is new."""
    return spine.join(changes, ["room", "t"], "left").select("room", "t", F.coalesce("topicChange", F.lit(0.0)).alias("topicChange"))
