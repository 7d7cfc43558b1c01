"""Cutting a recording into files: a file ends after the chunk with which it is old or large enough.

Where a file ends depends on where it began, so the cuts of a room are a chain. Every chunk knows the
start of the file after it, if one began with it (two growing range frames over running sums). Rooms are cut
into blocks of chunks; a block knows where a chain that enters it at any chunk comes out again, and only chunks at
which some chain enters a block are left for pointer jumping: in each round known entries double, as do the jumps.
A block's files are then walked from its one entry. No room is gathered in one task for that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.functions.settle import settle
from tidepeak.schema import room_type

#: Seconds and bytes after which a new file begins.
SECONDS, BYTES = 1800.0, 4 << 30
#: Chunks of a block.
BLOCK = 1 << 16


def following(chunks: DataFrame, seconds: float = SECONDS, size: int = BYTES) -> DataFrame:
    """(room, idx, ts, bytes, after, reason): chunks (room, ts, bytes) in order, with the place of the chunk after a file that would begin with each, and what ends it; null for a file that stays open."""
    order = Window.partitionBy("room").orderBy("ts", "bytes")
    rows = chunks.select("room", "ts", F.col("bytes").cast("bigint").alias("bytes")).withColumn("idx", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    rows = rows.withColumn("before", before).withColumn("micros", F.unix_micros("ts"))
    # places count from 0: the first chunk at or beyond a bound has the number of those below it; such a frame only grows, one to the end of the room is read anew for each row
    ahead = lambda by, step: F.count(F.lit(1)).over(Window.partitionBy("room").orderBy(by).rangeBetween(Window.unboundedPreceding, step - 1))
    # the chunk that makes a file old is its last, the one before which enough was written is the next
    old, large = ahead("micros", round(seconds * 1e6)) + 1, ahead("before", size)
    rows = rows.withColumn("old", old).withColumn("large", large).withColumn("last", F.max("idx").over(Window.partitionBy("room")))
    after = F.least("old", "large")
    closed = after <= F.col("last")
    reason = F.when(F.col("old") <= F.col("large"), "rotation").otherwise("size_cap")
    return rows.select("room", "idx", "ts", "bytes", F.when(closed, after).alias("after"), F.when(closed, reason).alias("reason"))


def reached(known: DataFrame, jump: DataFrame) -> DataFrame:
    """(room, idx) of all that is on the chains from known (room, idx) along jumps (room, idx, after)."""
    n = known.count()
    while True:
        more = known.join(jump, ["room", "idx"]).select("room", F.col("after").alias("idx"))
        known = settle(known.unionByName(more).distinct())
        n, before = known.count(), n
        if n == before:
            return known
        further = jump.select("room", F.col("idx").alias("after"), F.col("after").alias("further"))
        jump = settle(jump.join(further, ["room", "after"]).select("room", "idx", F.col("further").alias("after")))


def starts(jumps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(room, idx) of the chain from the first chunk of each room along jumps (room, idx, after)."""
    room = room_type(jumps)

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        first, to = int(rows["idx"].iloc[0]), rows["after"].to_numpy(np.int64)
        while (inside := (to >= 0) & (to < first + len(to))).any():
            to[inside] = to[to[inside] - first]
        out = rows[["room", "idx"]].assign(after=to)
        return out[out["after"] >= 0]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        first, to = int(rows["idx"].iloc[0]), rows["after"].tolist()
        at, found = int(rows["entry"].iloc[0]), []
        while first <= at < first + len(to):
            found.append(at)
            at = to[at - first]
        return pd.DataFrame({"room": [rows["room"].iloc[0]] * len(found), "idx": found})

    rows = jumps.select("room", F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("after").cast("long"), F.lit(-1)).alias("after"), F.floor(F.col("idx") / block).alias("block"))
    first = settle(rows.where("idx = 0").select("room", "idx"))
    out = settle(rows.groupBy("room", "block").applyInPandas(leave, f"room {room}, idx long, after long"))
    entries = first.unionByName(out.select("room", F.col("after").alias("idx"))).distinct()
    known = reached(first, settle(out.join(entries, ["room", "idx"])))
    # a chain enters a block once
    entered = known.select("room", F.floor(F.col("idx") / block).alias("block"), F.col("idx").alias("entry"))
    return settle(rows.join(entered, ["room", "block"]).groupBy("room", "block").applyInPandas(walk, f"room {room}, idx long"))


def rotated_by_size(chunks: DataFrame, seconds: float = SECONDS, size: int = BYTES) -> DataFrame:
    """(room, idx, ts, bytes, file): chunks with the number of their file, from 0."""
    rows = settle(following(chunks, seconds, size))
    first = starts(rows).withColumn("new", F.lit(1))
    run = Window.partitionBy("room").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(first, ["room", "idx"], "left").withColumn("file", (F.sum(F.coalesce("new", F.lit(0))).over(run) - 1).cast("int")).select("room", "idx", "ts", "bytes", "file")


def files(chunks: DataFrame, seconds: float = SECONDS, size: int = BYTES) -> DataFrame:
    """(room, file, first, last, chunks, bytes, reason): the files, and what ended each; the last of a room is open."""
    rows = settle(following(chunks, seconds, size))
    first = starts(rows)
    begun = first.join(rows, ["room", "idx"]).select("room", "idx", "reason", (F.row_number().over(Window.partitionBy("room").orderBy("idx")) - 1).alias("file"))
    named = rows.join(begun.select("room", "idx", "file"), ["room", "idx"], "left")
    run = Window.partitionBy("room").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = named.withColumn("file", F.last("file", True).over(run)).groupBy("room", "file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"))
    return sums.join(begun.select("room", "file", "reason"), ["room", "file"]).select("room", "file", "first", "last", "chunks", "bytes", F.coalesce("reason", F.lit("open")).alias("reason"))
