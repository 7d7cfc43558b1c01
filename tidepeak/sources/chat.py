"""Chat lines, transcripts, feature files, annotations and subtitles as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepeak.schema import CHAT

#: Texts that count as true.
TRUE = ("true", "1", "yes", "y", "是")
SEGMENTS = "array<struct<start:double,end:double,text:string,content:string,sentence:string,speaker:string>>"


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the known fields as text; a line that is no object has only _corrupt_record."""
    parsed = F.from_json("value", CHAT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("j")).select("j.*")


def split_bad(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones."""
    return lines.where("_corrupt_record IS NULL"), lines.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def typed_chat(rows: DataFrame) -> DataFrame:
    """ts, content, user_id and type of raw lines, with fallbacks from one field to the next; times that are no numbers are passed over."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    return rows.select(F.coalesce(number("recvTimeSec"), number("timestamp"), number("_time"), F.lit(0.0)).alias("ts"), text("content", "text").alias("content"), text("userId", "user_id").alias("user_id"), "type")


def transcript(doc: Column) -> Column:
    """Segments of a transcript that is a list, or an object with a list under `segments`."""
    return F.when(F.trim(doc).startswith("["), F.from_json(doc, SEGMENTS)).otherwise(F.from_json(doc, f"struct<segments:{SEGMENTS}>")["segments"])


def transcript_status(doc: Column) -> Column:
    """missing, invalid, failed, empty or ok."""
    trimmed = F.trim(doc)
    outer = F.from_json(doc, "struct<status:string,error:string>")
    items = transcript(doc)
    return (
        F.when(doc.isNull() | (trimmed == ""), "missing")
        .when(~trimmed.startswith("[") & ~trimmed.startswith("{"), "invalid")
        .when(trimmed.startswith("{") & (outer["status"] == "failed"), "failed")
        .when(items.isNull(), "invalid")
        .when(F.size(items) == 0, "empty")
        .otherwise("ok")
    )


def transcript_report(docs: DataFrame) -> DataFrame:
    """(room, status, degraded, segments, duration, error) of docs (room, doc): degraded if only chat can be used; duration is the last end."""
    status = transcript_status(F.col("doc"))
    items = F.coalesce(transcript(F.col("doc")), F.array().cast(SEGMENTS))
    last = F.array_max(F.transform(items, lambda x: x["end"]))
    error = F.from_json("doc", "struct<status:string,error:string>")["error"]
    return docs.select(
        "room", status.alias("status"), (~status.isin("ok", "empty") | (F.size(items) == 0)).alias("degraded"), F.size(items).alias("segments"), F.greatest(F.lit(0.0), F.coalesce(last, F.lit(0.0))).alias("duration"),
        F.substring(F.when(F.trim("doc").startswith("{"), error), 1, 300).alias("error"),
    )


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(line): lines of a JSON-lines file that are objects; none if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], "line string")
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())


def segments(docs: DataFrame) -> DataFrame:
    """(room, seg_idx, start, end, text, speaker) of docs (room, doc); times to 0.1 s; segments without times are left out."""
    each = docs.select("room", F.posexplode(transcript(F.col("doc"))).alias("seg_idx", "s"))
    text = F.coalesce(F.col("s.text"), F.col("s.content"), F.col("s.sentence"), F.lit(""))
    return each.select("room", "seg_idx", F.bround("s.start", 1).alias("start"), F.bround("s.end", 1).alias("end"), text.alias("text"), "s.speaker").where("start IS NOT NULL AND end IS NOT NULL")


def feature_signals(docs: DataFrame) -> DataFrame:
    """(room, signal, t, value) of docs (room, doc) with {"features": {name: [numbers]}}; empty and null arrays give nothing."""
    features = F.coalesce(F.from_json("doc", "struct<features:map<string,array<double>>>")["features"], F.create_map().cast("map<string,array<double>>"))
    each = docs.select("room", F.explode(features).alias("signal", "vals"))
    return each.select("room", "signal", F.posexplode("vals").alias("t", "value"))


def annotations(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid annotations and rejected ones (with the reason) of docs (room, doc): a list, or an object with one under `annotations`."""
    item = "array<struct<id:string,start:double,end:double,type:string,quality:string,worthClipping:string,notes:string>>"
    items = F.when(F.trim("doc").startswith("["), F.from_json("doc", item)).otherwise(F.from_json("doc", f"struct<annotations:{item}>")["annotations"])
    each = docs.select("room", F.posexplode(items).alias("pos", "a")).select("room", "pos", "a.*")
    rows = each.withColumn("id", F.coalesce("id", F.concat(F.lit("a"), (F.col("pos") + 1).cast("string"))))
    rows = rows.withColumn("quality", F.expr("try_cast(coalesce(quality, '3') AS int)")).withColumn("worth", F.lower(F.coalesce("worthClipping", F.lit("true"))).isin(*TRUE))
    rows = rows.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("room", "id")))
    bad = F.coalesce(
        F.when(F.col("start").isNull() | F.col("end").isNull() | F.isnan("start") | F.isnan("end"), F.lit("no time")), F.when(F.col("start") < 0, F.lit("negative start")), F.when(F.col("end") <= F.col("start"), F.lit("empty interval")),
        F.when(F.col("quality").isNull() | ~F.col("quality").between(1, 5), F.lit("quality out of range")), F.when(F.col("same") > 1, F.lit("repeated id")),
    )
    judged = rows.withColumn("problem", bad)
    good = judged.where("problem IS NULL").select("room", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "type", "quality", "worth", "notes")
    return good, judged.where("problem IS NOT NULL").select("room", "id", "problem")


def keyword_rows(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """(category, phrase), each phrase once a category."""
    return spark.createDataFrame([(c, p) for c, ps in table.items() for p in dict.fromkeys(ps)], "category string, phrase string")


def parse_srt(docs: DataFrame) -> DataFrame:
    """(room, idx, start, end, text) of subtitle texts (room, doc), of any line ends; blocks of another form are left out."""
    lines = F.regexp_replace(F.regexp_replace("doc", r"\r\n", "\n"), r"\r", "\n")
    block = docs.select("room", F.explode(F.split(F.trim(lines), r"\n\n+")).alias("b"))
    form = r"^(\d+)\n(\d{2}):(\d{2}):(\d{2}),(\d{3}) --> (\d{2}):(\d{2}):(\d{2}),(\d{3})\n([\s\S]*)"
    part = lambda i: F.regexp_extract("b", form, i)
    secs = lambda i: part(i).cast("int") * 3600 + part(i + 1).cast("int") * 60 + part(i + 2).cast("int") + part(i + 3).cast("int") / 1000.0
    return block.where(F.col("b").rlike(form)).select("room", part(1).cast("int").alias("idx"), secs(2).alias("start"), secs(6).alias("end"), F.trim(part(10)).alias("text"))


def cookies(text: Column) -> Column:
    """Map of `k=v; k=v`, with printable ASCII values only."""
    pairs = F.filter(F.split(text, ";"), lambda p: p.contains("=") & p.rlike(r"^[\x20-\x7E]*$"))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, entry)))


def netscape_cookies(lines: DataFrame) -> DataFrame:
    """(name, value) of cookie files (column value): seven columns apart by tabs; comments are passed over."""
    cells = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("#") & (F.size(cells) == 7)).select(F.get(cells, F.lit(5)).alias("name"), F.get(cells, F.lit(6)).alias("value"))


def largest_media(files: DataFrame) -> DataFrame:
    """(path) of the largest mp4 or flv file of each folder, from binaryFile rows."""
    media = files.where(F.lower("path").rlike(r"\.(mp4|flv)$")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return media.groupBy("folder").agg(F.max_by("path", F.struct("length", "path")).alias("path"))
