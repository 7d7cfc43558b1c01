"""Tables and documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_signals(signals: DataFrame, path: str) -> None:
    """Parquet, a folder for each room; the writer's commit makes it whole or absent."""
    signals.repartition("room").write.mode("overwrite").partitionBy("room").parquet(path)


def documents(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc): the rows of each key as one JSON array, in order of their fields."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("doc"))


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def events(rows: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """(value): rows as JSON events, with core fields apart from the extras."""
    extras = [c for c in rows.columns if c not in core]
    pairs = [x for c in extras for x in (F.lit(c), F.col(c).cast("string"))]
    return rows.select(F.to_json(F.struct(*core, F.create_map(*pairs).alias("extras") if pairs else F.lit(None).cast("map<string,string>").alias("extras"))).alias("value"))
