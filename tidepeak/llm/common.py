"""Shared helpers: scratch tables, Arrow batch limits, small column idioms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits (every non-ASCII character counts as part of a word).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session may go without: it gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("tidepeak.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidepeak-")
        spark.conf.set("tidepeak.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts, unless the session has limits of its own."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(value))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = next(m for m in ("_" * n for n in range(1, len(taken) + 2)) if not any(f"{m}{name}".lower() in taken for name in names))
    return [f"{mark}{name}" for name in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds value to a lambda variable, so that body's inner lambdas evaluate it once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between NON_WORD runs of the text in ASCII lower case; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NON_WORD), "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids give null."""
    return F.crc32(doc_id.cast("string")) % divisor
