"""Token counts with a digest cache.

A text is known by the digest of its content and of its tokenizer. Counts that the cache holds
are joined; each distinct text that it lacks is encoded once, and appended to the cache. Digests alone are
compared with the cache: a text moves only if its digest is missing, and then after a local choice of one
text a digest, so that any number of copies costs one row a task. Counts come back to documents by digest;
digests of very many documents are few and broadcast, so that no task gets all copies of a text.

Defined cases: null text counts as empty text, with 0 bytes and 0 tokens; repeated rows and ids
each get their row; an empty table gives no rows; texts of any length are counted whole; other columns do
not take part. The content is not changed for its digest, since any change could change the count:
normalising is only null to empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, materialise, scratch_path

LIMIT = 4096
MEMO = 300_000
#: Digests (32 bytes each) that may be broadcast; documents of a common digest, and the most such digests there can be.
BROADCAST, COMMON, MOST = 1_000_000, 1000, 10_000
SCHEMA = "digest binary, version string, n_tokens bigint"


class PieceCounter:
    """Counts of the library for a .model file, with a memo of words.

    No piece of the model goes on past a space mark that follows another letter, so runs of
    spaces with the word after them are counted one by one. That is looked up in the model;
    otherwise whole texts are encoded.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.parts = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and self.model.encode("a  b ", out_type=str)[-1] == self.MARK
        self.unit = regex.compile(r" +[^ ]*")
        self.known: dict[str, int] = {}

    def learn(self, units: list[str]) -> None:
        for unit, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1), strict=True):
            self.known[unit] = len(ids)
        self.known[" "] = 1

    def count_batch(self, texts: list[str]) -> list[int]:
        # U+2581 in a text is the same as a space to the library; its own clean-up of odd texts is left to it
        split = [([" " + u for u in t.split(" ")] if "  " not in t and t[:1] != " " and t[-1:] != " " else self.unit.findall(" " + t)) if self.parts and t and self.MARK not in t else None for t in texts]
        if len(self.known) >= MEMO:
            self.known.clear()
        if new := [*{u for units in split if units for u in units}.difference(self.known)]:
            self.learn(new)
        known = self.known.__getitem__
        return [sum(map(known, units)) if units else len(self.model.encode(t, num_threads=1)) for t, units in zip(texts, split, strict=True)]


_LOADED: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_column(text: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(counter(path).count_batch([t or "" for t in texts.to_pylist()]), pa.int64())

    return count_tokens(text)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def open_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache in a folder, which is made if it isn't there."""
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def fill(docs: DataFrame, path: str, folder: str) -> int:
    """Encodes the distinct texts of docs(text) that the cache lacks, appends their counts, and returns how many."""
    spark = docs.sparkSession
    bound_batches(spark)
    version = tokenizer_version(path)
    known = open_cache(spark, folder).where(F.col("version") == version).select("digest").distinct()
    misses = docs.select(digest(docs["text"]).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    if not known.isEmpty():
        missing = materialise(misses.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        n = missing.count()
        if not n:
            return 0
        misses = misses.join(F.broadcast(missing) if n <= BROADCAST else missing, "digest", "left_semi")
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))
    counted = materialise(distinct.select("digest", F.lit(version).alias("version"), count_column(F.col("text"), path).alias("n_tokens")), "token-counts")
    counted.write.mode("append").parquet(folder)
    return counted.count()


def count(docs: DataFrame, path: str, folder: str | None = None, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; folder holds the cache (a new one by default)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-count-cache")
    fill(docs, path, folder)
    cache = open_cache(spark, folder).where(F.col("version") == tokenizer_version(path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = materialise(docs.select("doc_id", digest(docs["text"]).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "document-digests")
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(common, rows.count() // MOST))).select("digest")
    often = materialise(often.join(cache, "digest"), "common-digests")
    counted = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(cache, "digest")
    counted = counted.unionByName(rows.join(F.broadcast(often), "digest"))  # at most MOST of them
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
