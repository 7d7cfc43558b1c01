"""Result documents of a recording: time table, candidates, scores. One row a room: (room, doc), doc being JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(rows: DataFrame, to: str, *order: str) -> DataFrame:
    """(room, to): the rows of each room as an array of structs, in order of the given columns."""
    fields = [c for c in rows.columns if c != "room"]
    keyed = rows.groupBy("room").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row")))).alias(to))
    return keyed.select("room", F.transform(to, lambda x: x["row"]).alias(to))


def document(rooms: DataFrame, parts: dict[str, DataFrame], **settings: Column) -> DataFrame:
    """(room, doc): the settings and the parts (room, array) of each room as one JSON object; a room that a part lacks has an empty list there."""
    out = rooms
    for rows in parts.values():
        out = out.join(rows, "room", "left")
    lists = [F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in parts]
    return out.select("room", F.to_json(F.struct(F.col("room").cast("string").alias("roomId"), *[v.alias(k) for k, v in settings.items()], *lists), {"ignoreNullFields": "false"}).alias("doc"))


def time_table(curve: DataFrame, clips: DataFrame, dropped: DataFrame, adjustments: DataFrame, profile: str = "default", low: float = 15.0, high: float = 90.0) -> DataFrame:
    """(room, doc): duration, profile and bounds, with clips, dropped ones and adjustments, each by start."""
    rooms = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    parts = {"clips": listed(clips, "clips", "start", "end"), "dropped": listed(dropped, "dropped", "start", "end", "reason"), "adjustments": listed(adjustments, "adjustments", "start", "end", "reason")}
    return document(rooms, parts, duration=F.col("n"), profile=F.lit(profile), minDuration=F.lit(low), maxDuration=F.lit(high))


def signal_stats(z: DataFrame, weights: DataFrame) -> DataFrame:
    """(room, signal, ord, weight, mean_z, max_z, contribution): rounded statistics of every signal, weighted or not."""
    stats = z.groupBy("room", "signal", "ord").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.avg(F.abs("value")).alias("size"))
    w = F.coalesce("w", F.lit(0.0))
    out = stats.join(weights, ["room", "signal"], "left")
    return out.select("room", "signal", "ord", F.round(w, 4).alias("weight"), F.round("mean", 4).alias("mean_z"), F.round("most", 4).alias("max_z"), F.round(w * F.col("size"), 4).alias("contribution"))


def scores(curve: DataFrame, z: DataFrame, weights: DataFrame, alignment: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(room, doc): the curve, weights, statistics of signals, and the names of the strongest ones by contribution."""
    rooms = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    stats = signal_stats(z, weights)
    rank = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("contribution"), "ord"))
    best = stats.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    named = best.groupBy("room").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "signal"))), lambda x: x["signal"]).alias("topSignals"))
    line = curve.groupBy("room").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "score"))), lambda x: F.round(x["score"], 6)).alias("scores"))
    parts = {"scores": line, "topSignals": named, "weights": listed(weights.select("room", "signal", F.round("w", 4).alias("w")), "weights", "signal"), "signalStats": listed(stats.drop("ord"), "signalStats", "signal")}
    if alignment is not None:
        parts["alignment"] = listed(alignment, "alignment", "signal")
    return document(rooms, parts, duration=F.col("n"))


def candidates(curve: DataFrame, found: DataFrame, weights: DataFrame, profile: str = "default") -> DataFrame:
    """(room, doc): first-stage candidates with the curve and weights they come from."""
    rooms = curve.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    line = curve.groupBy("room").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "score"))), lambda x: F.round(x["score"], 6)).alias("recallCurve"))
    parts = {"candidates": listed(found, "candidates", "start", "id"), "recallCurve": line, "weights": listed(weights.select("room", "signal", F.round("w", 6).alias("w")), "weights", "signal")}
    return document(rooms, parts, duration=F.col("n"), profile=F.lit(profile))


def clip_documents(metadata: DataFrame) -> DataFrame:
    """(room, id, doc): one JSON document a clip."""
    return metadata.select("room", "id", F.to_json(F.struct(*[c for c in metadata.columns if c != "room"])).alias("doc"))
