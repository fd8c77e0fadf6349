"""Baselines in versions (S3, S4), switched by one conditional create.

``<path>/versions/version=<id>/repo=<repo>/…`` holds what a write wrote, and
``<path>/log/<n>`` names the version that the n-th commit added. Readers see
only versions that the log names, and of each repository its last one, so a
write that fails or runs leaves what is there as it is. A writer commits by
creating the next entry, which only one can: the other looks again and, unless it
forces, refuses if the repository has a baseline by now.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from faultline.schemas import BASELINE
from faultline.sources.baseline_store import BaselineExistsError

_STORED = T.StructType([*BASELINE.fields, T.StructField("version", T.StringType())])


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _entries(spark: SparkSession, path: str) -> list[str]:
    """The versions that were committed, in order."""
    store, log = _hadoop(spark, f"{path}/log")
    if not store.exists(log):
        return []
    numbers = sorted(int(s.getPath().getName()) for s in store.listStatus(log) if s.getPath().getName().isdigit())
    out = []
    for n in numbers:
        file = store.open(_hadoop(spark, f"{path}/log/{n:08d}")[1])
        try:
            out.append(bytes(file.readAllBytes()).decode())
        finally:
            file.close()
    return out


def _create(spark: SparkSession, path: str, n: int, text: str) -> bool:
    """The n-th log entry, unless there is one. Hadoop's stores create without
    overwriting as one step; its local one doesn't, so that goes through the system."""
    store, log = _hadoop(spark, f"{path}/log")
    store.mkdirs(log)
    store, entry = _hadoop(spark, f"{path}/log/{n:08d}")
    uri = store.makeQualified(entry).toUri()
    if uri.getScheme() == "file":
        # The entry appears whole: linked under its name once it is written.
        draft = f"{uri.getPath()}.{uuid.uuid4().hex}"
        with open(draft, "w") as file:
            file.write(text)
        try:
            os.link(draft, uri.getPath())
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        file = store.create(entry, False)
    except Exception as e:
        if store.exists(entry):
            return False
        raise e
    file.write(text.encode())
    file.close()
    return True


def _current(spark: SparkSession, path: str, versions: list[str]) -> DataFrame:
    """``repo, version``: each repository's last committed version."""
    order = spark.createDataFrame([(v, i) for i, v in enumerate(versions)], "version string, n int")
    held = spark.read.schema(_STORED).parquet(f"{path}/versions").select("repo", "version").distinct()
    return held.join(order, "version").groupBy("repo").agg(F.max_by("version", "n").alias("version"))


def commit_baseline(rows: DataFrame, path: str, force: bool = False) -> str:
    """Writes baseline rows (schema ``BASELINE``) as a version and commits it;
    returns its id. Refuses if a repository has a baseline, also one that another
    writer commits meanwhile, unless forced; a forced write replaces its own repositories only."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    at = f"{path}/versions/version={version}"
    rows.select(*[F.col(f.name).cast(f.dataType) for f in BASELINE.fields]).hint("rebalance", "repo").write.partitionBy("repo").parquet(at)
    while True:
        versions = _entries(spark, path)
        if versions and not force:
            mine = spark.read.schema(BASELINE).parquet(at).select("repo").distinct()
            if not mine.join(_current(spark, path, versions), "repo", "left_semi").isEmpty():
                raise BaselineExistsError(f"A baseline already exists at {path} for at least one of these repositories; pass force=True to overwrite it.")
        if _create(spark, path, len(versions), version):
            return version


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Each repository's last committed baseline, or None when there is none."""
    versions = _entries(spark, path)
    if not versions:
        return None
    rows = spark.read.schema(_STORED).parquet(f"{path}/versions")
    return rows.join(_current(spark, path, versions), ["repo", "version"]).select(*[f.name for f in BASELINE.fields])
