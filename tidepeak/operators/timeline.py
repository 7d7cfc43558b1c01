"""Ticks, dense spines, alignment and resampling of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.schema import EVENTS, SIGNALS


def per(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def duration(explicit: Column, asr_end: Column, chat_time: Column) -> Column:
    """An explicit positive duration, else the last end or message time, never negative."""
    return F.coalesce(F.when(explicit > 0, explicit), F.greatest(F.coalesce(asr_end, F.lit(0.0)), F.coalesce(chat_time, F.lit(0.0)), F.lit(0.0)))


def target_length(seconds: Column) -> Column:
    """Ticks of a recording of so many seconds; null if the length is not known."""
    return F.when(seconds > 0, F.ceil(seconds)).cast("int")


def tick_of(seconds: Column, width: float = 1.0) -> Column:
    """Tick of a time, truncated toward zero."""
    return (seconds / F.lit(width)).cast("int")


def in_range(rows: DataFrame, n: int) -> DataFrame:
    """Rows of ticks 0 to n - 1; others are out of the recording."""
    return rows.where(F.col("t").between(0, n - 1))


def skipped(rows: DataFrame, n: int) -> DataFrame:
    """How many rows of each room fall outside the recording."""
    return rows.groupBy("room").agg(F.count_if(~F.col("t").between(0, n - 1)).alias("skipped"), F.count(F.lit(1)).alias("rows"))


def spine(rooms: DataFrame, n: int) -> DataFrame:
    """(room, t) for every tick of every room."""
    return rooms.select("room").distinct().select("room", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))


def dense(rows: DataFrame, rooms: DataFrame, n: int, *columns: str, fill: float = 0.0) -> DataFrame:
    """Rows by (room, t), with one for every tick; missing values become fill."""
    return spine(rooms, n).join(rows, ["room", "t"], "left").select("room", "t", *[F.coalesce(c, F.lit(fill)).alias(c) for c in columns])


def align(signals: DataFrame, target: int) -> DataFrame:
    """Every (room, signal) at `target` ticks: longer ones cut, shorter events padded with zeros, others stretched linearly."""
    w = per("room", "signal")
    sized = signals.withColumn("old", F.max("t").over(w) + 1)
    event = F.col("signal").isin(*EVENTS)
    kept = sized.where((F.col("old") >= target) | event).where(F.col("t") < target).select("room", "signal", "t", "value", "old")
    short = sized.where(F.col("old") < target)
    padded = short.where(event).groupBy("room", "signal").agg(F.first("old").alias("old"))
    zeros = padded.select("room", "signal", F.explode(F.sequence("old", F.lit(target - 1))).alias("t"), F.lit(0.0).alias("value"), "old")
    # each source segment [i, i + 1) gives the target ticks whose position lies in it: no join back to the values
    ordered = w.orderBy("t")
    segment = short.where(~event).withColumn("following", F.coalesce(F.lead("value").over(ordered), F.col("value")))
    last = F.col("old") - 1
    ratio = F.lit(float(max(target - 1, 1)))
    first_t = F.when(last == 0, F.lit(0)).otherwise(F.ceil(F.col("t") * ratio / last)).cast("int")
    upto = F.when(F.col("t") == last, F.lit(target - 1)).otherwise(F.ceil((F.col("t") + 1) * ratio / last).cast("int") - 1)
    upto = F.when((last == 0) & (F.col("t") == 0), F.lit(target - 1)).otherwise(upto)
    position = F.col("tick") * last / ratio
    stretched = segment.where(first_t <= upto).withColumn("tick", F.explode(F.sequence(first_t, upto)))
    value = F.col("value") + (position - F.col("t")) * (F.col("following") - F.col("value"))
    stretched = stretched.select("room", "signal", F.col("tick").alias("t"), value.alias("value"), "old")
    return kept.unionByName(zeros).unionByName(stretched)


def alignment_report(signals: DataFrame, target: int) -> DataFrame:
    """(room, signal, old, target, how) for every signal that alignment changes."""
    sizes = signals.groupBy("room", "signal").agg((F.max("t") + 1).alias("old"))
    how = F.when(F.col("old") > target, "truncate").when(F.col("signal").isin(*EVENTS), "pad").otherwise("stretch")
    return sizes.where(F.col("old") != target).select("room", "signal", "old", F.lit(target).alias("target"), how.alias("how"))


def edge_pad(rows: DataFrame, n: int, event: bool = False) -> DataFrame:
    """Values by (room, t) at n ticks: cut, or continued by the last value (zero for events)."""
    w = Window.partitionBy("room").orderBy("t")
    full = spine(rows, n).join(rows, ["room", "t"], "left")
    fill = F.lit(0.0) if event else F.coalesce(F.last("value", True).over(w), F.lit(0.0))
    return full.select("room", "t", F.coalesce("value", fill).alias("value"))


def frames_to_ticks(frames: DataFrame, n: int, per_tick: int = 31) -> DataFrame:
    """Mean of the frames of each tick (a whole number of frames a tick), 0 where there is none."""
    means = frames.groupBy("room", F.floor(F.col("frame") / per_tick).cast("int").alias("t")).agg(F.avg("value").alias("value"))
    return dense(in_range(means, n), frames, n, "value")


def overwrite_union(*sources: DataFrame) -> DataFrame:
    """Union of signal tables where a later source replaces whole signals of an earlier one."""
    tagged = [s.select("room", "t", "signal", "value", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.withColumn("best", F.max("source").over(per("room", "signal"))).where("source = best").drop("best", "source")


def bucket_max(curve: DataFrame, target: int = 1200) -> DataFrame:
    """Curve by (room, t, score) thinned to at most `target` buckets, each its highest score."""
    sized = curve.withColumn("n", F.count(F.lit(1)).over(per("room")))
    bucket = F.when(F.col("n") <= target, F.col("t")).otherwise(F.expr(f"((t + 1) * {target}L - 1) DIV n"))
    return sized.withColumn("bucket", bucket.cast("int")).groupBy("room", "bucket").agg(F.max("score").alias("score"))


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(room, idx, dur) with the time at which each chunk starts."""
    before = Window.partitionBy("room").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("starts", F.coalesce(F.sum("dur").over(before), F.lit(0.0)))


def shift_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments (room, idx, start, end, text) on the time line of the whole recording, to 0.1 s."""
    at = chunk_offsets(chunks).select("room", "idx", "starts")
    moved = lambda c: F.bround(F.col(c) + F.col("starts"), 1).alias(c)
    return segments.join(at, ["room", "idx"]).select("room", moved("start"), moved("end"), "text")


def unknown_signals(signals: DataFrame) -> DataFrame:
    """Names that the vocabulary lacks."""
    names = signals.sparkSession.createDataFrame([(s,) for s in SIGNALS], "signal string")
    return signals.select("signal").distinct().join(F.broadcast(names), "signal", "left_anti")
