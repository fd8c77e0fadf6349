"""Model-answer source (S5) and analysis sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.schemas import RESPONSES


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``repo, path, raw_text`` answers produced elsewhere (explicit schema)."""
    return spark.read.format(fmt).schema(RESPONSES).load(path)


def write_analyses(analyses: DataFrame, path: str, fmt: str = "json",
                   mode: str = "errorifexists") -> None:
    """One structured record per analysed file, all fields including warnings,
    partitioned by repository."""
    analyses.hint("rebalance", "repo").write.mode(mode).partitionBy("repo").format(fmt).save(path)


def write_scan(rows: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    rows.write.mode(mode).format(fmt).save(path)
