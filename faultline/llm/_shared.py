"""What the operators share: the shared scratch folder and narrow tables in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests) gets a scratch folder when the setting is
    missing; on a cluster a missing setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-llm-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation, and
    a table that is used twice is computed once.
    """
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes`` of one text column
    (a longer single text stays whole)."""
    start, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if total and total + (n or 0) > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
