"""A corpus-cleaning pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepeak.llm import stages

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; stages meet in Parquet tables in the shared folder."""
    return stages.run(spark, sf_dir)
