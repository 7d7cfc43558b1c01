"""Structured Streaming: the same windows on a live chat table (room, ts, ...) as on a stored one.

The functions take streaming or batch tables alike. Late rows are bounded by a watermark, which is
an addition of this engine: a stored recording has none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepeak.schema import room_type

LATE = "10 seconds"


def read_events(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of one table in a folder, as a stream; the table is a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # a stream takes a pattern for either, and a plain path for a folder only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{name}}}")


def watermarked(chat: DataFrame, late: str = LATE) -> DataFrame:
    return chat.withWatermark("ts", late) if chat.isStreaming else chat


def tumbling_counts(chat: DataFrame, size: str = "1 second", late: str = LATE) -> DataFrame:
    """(room, start, n) of consecutive windows, and users if chat has user_id: counted approximately, on a stream and on a table alike."""
    grouped = watermarked(chat, late).groupBy("room", F.window("ts", size).alias("w"))
    users = [F.approx_count_distinct("user_id").alias("users")] if "user_id" in chat.columns else []
    return grouped.agg(F.count(F.lit(1)).alias("n"), *users).select("room", F.col("w.start").alias("start"), "n", *["users"] * len(users))


def sliding_counts(chat: DataFrame, size: str = "11 seconds", step: str = "1 second", late: str = LATE) -> DataFrame:
    grouped = watermarked(chat, late).groupBy("room", F.window("ts", size, step).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("room", F.col("w.start").alias("start"), "n")


def session_ranges(hot: DataFrame, gap: str = "3500 milliseconds", late: str = LATE) -> DataFrame:
    """(room, start, last, score, n) of runs of hot ticks (room, ts, score) with gaps below `gap`, the live form of peak ranges.

    Sessions that just touch are joined, so a gap of 3 whole seconds is any length between 3 and 4.
    """
    grouped = watermarked(hot, late).groupBy("room", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).drop("w")


def method_counts(chat: DataFrame) -> DataFrame:
    return chat.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stamped(chat: DataFrame, started: Column | None = None) -> DataFrame:
    """Adds received, the time of processing, and recv_sec, the seconds since `started` (a timestamp), to the millisecond; a stored received stays."""
    out = chat if "received" in chat.columns else chat.withColumn("received", F.current_timestamp())
    return out if started is None else out.withColumn("recv_sec", F.round((F.unix_micros("received") - F.unix_micros(started)) / 1e6, 3))


def recent(chat: DataFrame, keep: int = 1000) -> DataFrame:
    """(room, held, newest): how many of the last `keep` messages of a room (t, line_no, content) are held after each batch, and the newest; older ones leave the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            held = sorted([*held, *zip(rows["t"].astype(int), rows["line_no"].astype(int), rows["content"], strict=True)], key=lambda r: r[:2])[-keep:]
        state.update(tuple([r[i] for r in held] for i in range(3)))
        yield pd.DataFrame({"room": [key[0]], "held": [len(held)], "newest": [held[-1][2] if held else None]})

    return chat.groupBy("room").applyInPandasWithState(run, f"room {room_type(chat)}, held long, newest string", "t array<long>, line_no array<long>, content array<string>", "update", GroupStateTimeout.NoTimeout)


def idle_rooms(chat: DataFrame, after: str = "10 seconds") -> DataFrame:
    """(room, n, closed): a row when a room first speaks or speaks again, and one with closed when it was silent for `after` of processing time."""
    wait = int(pd.Timedelta(after).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"room": [key[0]], "n": [n], "closed": [True]})
            return
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        state.update((n,))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame({"room": [key[0]], "n": [n], "closed": [False]})

    return chat.groupBy("room").applyInPandasWithState(run, f"room {room_type(chat)}, n long, closed boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def supervised(start: Callable[[], StreamingQuery], retries: int = 5, delay: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a query to its end and starts it again if it fails, after `delay` seconds, doubled each time up to `longest`; returns the number of failures.

    The checkpoint of the query makes sure that a new start goes on where the last one stopped.
    """
    failed = 0
    while True:
        try:
            start().awaitTermination()
            return failed
        except Exception:
            failed += 1
            if failed > retries:
                raise
            sleep(min(longest, delay * 2 ** (failed - 1)))


def append_json(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends rows as JSON lines; the checkpoint makes sure that none is lost at a stop."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rotated(rows: DataFrame, size: str = "30 minutes") -> DataFrame:
    """Adds the start of the file window that a row belongs to, to partition a sink by."""
    return rows.withColumn("file_start", F.window("ts", size)["start"])
