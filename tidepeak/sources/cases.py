"""Cases of evaluation from folders: a time table, annotations and three feature files beside each other.

All files of all folders are one scan, keyed by the folder that they stand in. A case is told to be unusable, and why,
instead of stopping the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.config import PROFILES
from tidepeak.sources import chat

#: Names of the files of a case.
TABLE, NOTES = "time_table.json", "annotations.json"
FEATURES = {"audio": "audio_features.json", "text": "text_features.json", "visual": "visual_features.json"}
#: Settings of a time table that lacks them.
SENSITIVITY, SHORTEST, LONGEST = 2.5, 15.0, 90.0

CLIPS = "array<struct<id:bigint,start:double,end:double,score:double>>"
HEAD = f"struct<roomId:string,profile:string,duration:double,sensitivity:double,minDuration:double,maxDuration:double,clips:{CLIPS}>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, doc) of the files of all folders below root, whatever their depth."""
    names = [TABLE, NOTES, *FEATURES.values()]
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").text(root)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.substring_index(path, "/", -1).alias("name"), F.col("value").alias("doc"))


def cases(files: DataFrame, profiles: tuple[str, ...] = tuple(PROFILES)) -> DataFrame:
    """One row a folder: label, room_id, profile, duration, settings, clips, the documents of annotations and features, and problem.

    Annotations' profile comes before the table's, the table's duration and room before the annotations'. problem is null, or the first
    that holds: no or no valid time table, no annotations, no features, an unknown profile.
    """
    one = lambda name: F.first(F.when(F.col("name") == name, F.col("doc")), True)
    docs = files.groupBy("folder").agg(one(TABLE).alias("table"), one(NOTES).alias("notes"), *[one(name).alias(kind) for kind, name in FEATURES.items()])
    rows = docs.select("*", F.from_json("table", HEAD).alias("t"), F.from_json("notes", "struct<roomId:string,profile:string,duration:double>").alias("a"))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    number = lambda c: F.nullif(F.col(c), F.lit(0.0))
    profile = F.coalesce(text("a.profile"), text("t.profile"), F.lit("default"))
    held = [F.size(F.map_filter(F.coalesce(F.from_json(kind, "struct<features:map<string,array<double>>>")["features"], F.create_map().cast("map<string,array<double>>")), lambda k, v: F.size(v) > 0)) for kind in FEATURES]
    valid = F.try_parse_json("table").isNotNull() & F.trim("table").startswith("{")
    problem = F.coalesce(
        F.when(F.col("table").isNull(), F.lit("no time table")), F.when(~valid, F.lit("invalid time table")), F.when(F.col("notes").isNull(), F.lit("no annotations")), F.when(F.try_parse_json("notes").isNull(), F.lit("invalid annotations")),
        F.when(sum(held, F.lit(0)) == 0, F.lit("no features")), F.when(~profile.isin(*profiles), F.lit("unknown profile")),
    )
    missing = F.array_compact(F.array(*[F.when(F.col(kind).isNull(), F.lit(name)) for kind, name in FEATURES.items()]))
    return rows.select(
        "folder", F.substring_index("folder", "/", -1).alias("label"), F.coalesce(text("t.roomId"), text("a.roomId"), F.lit("")).alias("room_id"), profile.alias("profile"), F.coalesce(number("t.duration"), number("a.duration")).alias("duration"),
        F.coalesce("t.sensitivity", F.lit(SENSITIVITY)).alias("sensitivity"), F.coalesce("t.minDuration", F.lit(SHORTEST)).alias("min_duration"), F.coalesce("t.maxDuration", F.lit(LONGEST)).alias("max_duration"),
        F.coalesce("t.clips", F.array().cast(CLIPS)).alias("clips"), "notes", *FEATURES, missing.alias("missing"), problem.alias("problem"),
    )


def usable(found: DataFrame) -> DataFrame:
    return found.where("problem IS NULL")


def annotations(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations, and rejected ones, of cases; rooms are their folders' labels."""
    return chat.annotations(usable(found).select(F.col("label").alias("room"), F.col("notes").alias("doc")))


def clips(found: DataFrame) -> DataFrame:
    """(room, id, start, end, score) of the cases' clips; a clip without an id is known by its place."""
    each = usable(found).select(F.col("label").alias("room"), F.posexplode("clips").alias("pos", "c"))
    return each.select("room", F.coalesce("c.id", F.col("pos") + 1).alias("id"), "c.start", "c.end", F.coalesce("c.score", F.lit(0.0)).alias("score")).where("start IS NOT NULL AND end IS NOT NULL")


def signals(found: DataFrame) -> DataFrame:
    """(room, source, signal, t, value) of the cases' feature files; empty and null arrays give nothing."""
    each = usable(found).select("label", F.explode(F.array(*[F.struct(F.lit(kind).alias("source"), F.col(kind).alias("doc")) for kind in FEATURES])).alias("f"))
    features = F.from_json("f.doc", "struct<features:map<string,array<double>>>")["features"]
    long = each.select(F.col("label").alias("room"), "f.source", F.explode(features).alias("signal", "vals"))
    return long.select("room", "source", "signal", F.posexplode("vals").alias("t", "value"))
