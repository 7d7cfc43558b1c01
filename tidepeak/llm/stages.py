"""Stages of the corpus pipeline: each calls an operator on all rows that its predecessor kept.

Columns are those of documents (doc_id, text, lang, source, n_chars, and any others); all stages but
the last return them, with n_chars brought up to date where the text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.llm import bpe, decontam, langid, pseudonyms, resemblance
from tidepeak.llm.common import fresh, materialise
from tidepeak.llm.queries import PSEUDONYM_KEY, table, tokenizer_file

#: A document whose best language has a lower mean probability than this is rejected, as are those of no language.
LEAST_SCORE = 0.35


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no recognisable language: null texts, texts without a letter, and texts whose best language is unlikely."""
    lang, score = fresh(docs, "lang", "score")
    out = langid.identify(docs, langid.learn(docs), lang, score)
    return out.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (five words, similarity of 0.8 or more)."""
    return resemblance.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes spans of benchmark items, and documents that are mostly such spans; null texts stay."""
    return with_length(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; all documents stay."""
    return with_length(pseudonyms.masked(docs, PSEUDONYM_KEY))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (ids, n_tokens) of every text in the place of the text; all other columns stay, but for ones of these two names."""
    return bpe.encode(docs, tokenizer_file("word_bpe_49k.json")).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
