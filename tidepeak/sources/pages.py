"""Fields and stream addresses from live pages (page_id, url, html) and API payloads."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from html import unescape
from json import JSONDecodeError, JSONDecoder
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.functions.settle import settle

SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
STREAM = r"(https?://[^\s\"'<>]*?pull-flv[^\s\"'<>]*?_(or4|hd|sd|ld|md)\.flv[^\s\"'<>\\]*)"
#: Quality names that mean another.
QUALITIES = {"FULL_HD1": "or4", "HD1": "hd", "SD1": "sd", "SD2": "ld", "MD": "md"}
#: Fields of a room and the paths at which they stand.
FIELDS = {
    "room_id": ("$.roomId", "$.room.id_str", "$.roomInfo.roomId", "$.roomInfo.room.id_str"),
    "user_id": ("$.user_unique_id", "$.user.user_unique_id", "$.odin.user_unique_id"),
    "anchor_id": ("$.anchor.id_str", "$.roomInfo.anchor.id_str"),
    "sec_uid": ("$.anchor.sec_uid", "$.sec_uid", "$.roomInfo.anchor.sec_uid"),
    "status": ("$.roomInfo.room.status", "$.room.status", "$.status"),
    "title": ("$.roomInfo.room.title", "$.room.title", "$.title"),
}
#: The same fields in texts that are no JSON document.
PATTERNS = {
    "room_id": r"\"roomId\"\s*:\s*\"?(\d+)\"?", "user_id": r"\"user_unique_id\"\s*:\s*\"(\d+)\"", "anchor_id": r"\"anchor\"\s*:\s*\{\s*\"id_str\"\s*:\s*\"(\d+)\"", "sec_uid": r"\"sec_uid\"\s*:\s*\"([^\"]+)\"",
    "status": r"\"room\"\s*:\s*\{[\s\S]*?\"status\"\s*:\s*\"?(\d+)", "title": r"\"room\"\s*:\s*\{[\s\S]*?\"title\"\s*:\s*\"([^\"]*)\"",
}


def scripts(pages: DataFrame) -> DataFrame:
    """(page_id, pos, body) of every script of a page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("pos", "body"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every link of a page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"href=\"([^\"]*)\""), F.lit(1))).alias("pos", "href"))


def unescaped(text: Column) -> Column:
    """Slashes and quotes without their backslashes, and & for its entity."""
    return F.replace(F.replace(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def stream_urls(pages: DataFrame) -> DataFrame:
    """(page_id, quality, url): the first stream address of each quality."""
    body = scripts(pages).withColumn("body", unescaped(F.regexp_replace("body", r"\\u0026", "&")))
    each = body.select("page_id", "pos", F.posexplode(F.regexp_extract_all("body", F.lit(STREAM), F.lit(1))).alias("at", "url"))
    rows = each.withColumn("quality", F.lower(F.regexp_extract("url", r"_(or4|hd|sd|ld|md)\.flv", 1)))
    return rows.groupBy("page_id", "quality").agg(F.min_by("url", F.struct("pos", "at")).alias("url"))


def payload_values(payloads: DataFrame) -> DataFrame:
    """(id, path, key, text): every text of payloads (id, doc) at any depth, and the key that it stands under; texts in lists have the key of none.

    The documents are variants that are opened one level at a time, all of a level at once; documents that are no JSON have no texts.
    """
    spark = payloads.sparkSession
    level = settle(payloads.select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json("doc").alias("value")).where("value IS NOT NULL"))
    found = []
    while not level.isEmpty():
        open_ = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "name", "inner"))
        inside = settle(open_.select("id", F.concat("path", F.lit("/"), F.coalesce("name", F.col("pos").cast("string"))).alias("path"), F.col("name").alias("key"), F.col("inner").alias("value")))
        kind = F.schema_of_variant("value")
        found.append(inside.where(kind == "STRING").select("id", "path", "key", F.try_variant_get("value", "$", "string").alias("text")))
        level = inside.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    none = spark.createDataFrame([], "path string, key string, text string")
    return functools.reduce(DataFrame.unionByName, found) if found else payloads.select("id").where(F.lit(False)).join(none)


def payload_urls(payloads: DataFrame) -> DataFrame:
    """(id, quality, url) of payloads (id, doc): each text with .flv under a key at any depth, whose key, or whose own name, tells a quality.

    Of several of a quality the one that stands first in the document wins.
    """
    texts = payload_values(payloads).where(F.col("key").isNotNull() & F.col("text").contains(".flv"))
    named = F.coalesce(*[F.when(F.upper("key") == a, F.lit(q)) for a, q in QUALITIES.items()])
    own = F.nullif(F.lower(F.regexp_extract("text", r"(?i)_(or4|hd|sd|ld|md)\.flv", 1)), F.lit(""))
    key = F.when(F.lower("key").isin("or4", "hd", "sd", "ld", "md"), F.lower("key"))
    rows = texts.withColumn("quality", F.coalesce(named, own, key)).where("quality IS NOT NULL")
    # a variant keeps its keys sorted: the order is that of the texts in the document, without its escapes
    plain = F.replace(F.replace("doc", F.lit("\\u0026"), F.lit("&")), F.lit("\\/"), F.lit("/"))
    # documents are made from narrow columns: their size is taken for that of these, so a join may not choose to broadcast them
    placed = rows.join(payloads.select("id", plain.alias("plain")).hint("merge"), "id")
    at = F.expr("locate(text, plain)")
    first = placed.groupBy("id", "quality").agg(F.min_by("text", F.struct(F.when(at == 0, F.lit(2**31 - 1)).otherwise(at), F.col("path"))).alias("url"))
    return first.select("id", "quality", F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


#: Names before a page's state, and words of the scripts that may hold a room.
STATE_MARKERS = ("__INITIAL_STATE__", "__NUXT__", "__SSR_DATA__", "__NEXT_DATA__")
SCRIPT_WORDS = ("roomId", "pull-flv", "flv_pull_url")


def _documents(html: str) -> Iterator[str]:
    """JSON documents of a page: the render data, after state markers, in scripts; the first that decodes from a brace."""
    decoder = JSONDecoder()

    def first(text: str) -> str | None:
        at = text.find("{")
        if at < 0:
            return None
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except JSONDecodeError:
            return None

    parts = html.split("<script")[1:]
    bodies = [p.partition(">")[2].partition("</script>")[0] for p in parts]
    for head, body in zip(parts, bodies, strict=True):
        if "RENDER_DATA" in head.partition(">")[0]:
            text = unescape(body.strip())
            yield from filter(None, [first(unquote(text)) or first(text)])
    for marker in STATE_MARKERS:
        for tail in html.split(marker)[1:]:
            yield from filter(None, [first(tail)])
    for body in bodies:
        if any(word in body for word in SCRIPT_WORDS):
            plain = body.replace("\\/", "/").replace('\\"', '"')
            yield from filter(None, [first(body) or first(plain)])


def embedded_json(pages: DataFrame) -> DataFrame:
    """(page_id, pos, doc): JSON documents inside each page. A prefix that decodes has no end that SQL can see, so this is a pandas step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(r.page_id, i, d) for r in rows.itertuples() for i, d in enumerate(_documents(r.html or ""))]
            yield pd.DataFrame(out, columns=["page_id", "pos", "doc"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, doc string")


def room_info(pages: DataFrame) -> DataFrame:
    """One row a page with the fields of its room: from its JSON by path, what is missing by pattern; empty where neither has it."""
    value = {f: F.coalesce(*[F.nullif(F.get_json_object("doc", p), F.lit("")) for p in paths]) for f, paths in FIELDS.items()}
    docs = embedded_json(pages).select("page_id", "pos", *[v.alias(f) for f, v in value.items()])
    first = docs.groupBy("page_id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in FIELDS])
    plain = unescaped(F.col("html"))
    by_pattern = pages.select("page_id", "url", *[F.regexp_extract(plain, p, 1).alias(f"p_{f}") for f, p in PATTERNS.items()])
    return by_pattern.join(first, "page_id", "left").select("page_id", "url", *[F.coalesce(f, f"p_{f}").alias(f) for f in FIELDS])
