"""Baseline sink (S3) and corruption-tolerant baseline source.

The table form is parquet partitioned by ``repo``: one partition per
repository, every file of the repository in it. Writing refuses to replace an
existing repository's baseline unless forced; a forced write replaces only the
partitions being written (dynamic partition overwrite).

The document form (one JSON object per repository with a ``files`` map keyed by
relative path, the single-machine layout) is read with an explicit schema; a
document that does not parse is reported and treated as absent, the others are
used.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from faultline.schemas import BASELINE, BASELINE_DOC

log = logging.getLogger(__name__)
BROKEN = "_corrupt_record IS NOT NULL OR files IS NULL"


class BaselineExistsError(RuntimeError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def baseline_exists(spark: SparkSession, path: str, repos: DataFrame | None = None,
                    fmt: str = "parquet") -> bool:
    """Is there a baseline at ``path`` (for any of ``repos`` when given)?
    Only the ``repo=`` partition directories are consulted."""
    if not _exists(spark, path):
        return False
    if repos is None:
        return True
    have = spark.read.schema(BASELINE).format(fmt).load(path).select("repo").distinct()
    return have.join(repos.select("repo").distinct(), "repo", "left_semi").limit(1).count() > 0


def save_baseline(rows: DataFrame, path: str, force: bool = False, fmt: str = "parquet") -> None:
    """Write baseline rows (schema ``BASELINE``), refusing to overwrite.
    ``fmt`` is ``parquet`` or ``json`` (JSON lines, one row per file)."""
    spark = rows.sparkSession
    out = rows.select(*[F.col(f.name).cast(f.dataType) for f in BASELINE.fields])
    if not force and baseline_exists(spark, path, out, fmt):
        raise BaselineExistsError(
            f"A baseline already exists at {path} for at least one of these repositories; "
            "pass force=True to overwrite it.")
    # One file per repository, more for a large one, whatever number of tasks made the rows.
    (out.hint("rebalance", "repo").write.mode("overwrite" if force or _exists(spark, path) else "errorifexists")
     .option("partitionOverwriteMode", "dynamic").partitionBy("repo").format(fmt).save(path))


def load_baseline(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The baseline table at ``path``, or None when there is none. Lines of a JSON
    baseline that don't parse, and rows without a file, count as absent; their
    exact number is logged."""
    if not _exists(spark, path):
        return None
    if fmt != "json":
        rows = spark.read.schema(BASELINE).format(fmt).load(path)
    else:
        schema = T.StructType(BASELINE.fields + [T.StructField("_corrupt_record", T.StringType())])
        rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        broken = rows.filter(F.col("_corrupt_record").isNotNull() | F.col("rel_path").isNull()).select("repo", "_corrupt_record", "rel_path").count()
        if broken:
            log.warning("%d baseline lines under %s can't be read — ignoring them for this run.", broken, path)
        rows = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return rows.filter(F.col("rel_path").isNotNull())


def _documents(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(BASELINE_DOC.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("_file", F.col("_metadata.file_path")))


def corrupt_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of every baseline document that can't be read."""
    return _documents(spark, path).filter(BROKEN).select(F.col("_file").alias("file"))


def load_baseline_documents(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame | None:
    """Baseline rows from JSON documents; unreadable documents are counted in
    the log (:func:`corrupt_documents` lists them all) and skipped: that
    repository behaves as if it had no baseline.

    A document without a ``repo`` member is of the repository given, or of the
    one its path names: a ``repo=<repo>/`` directory, else the file's name."""
    if not _exists(spark, path):
        return None
    n = corrupt_documents(spark, path).count()
    if n:
        log.warning("%d baseline documents under %s can't be read — ignoring them for this run.", n, path)
    named = F.coalesce(F.col("repo"), F.lit(repo) if repo else F.when(
        F.col("_file").rlike("/repo=[^/]+/"), F.regexp_extract("_file", "/repo=([^/]+)/", 1)).otherwise(
        F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1)))
    e = _documents(spark, path).filter(f"NOT ({BROKEN})").select(
        named.alias("repo"), "createdAt", "toolVersion", F.explode("files").alias("rel_path", "f"))
    return e.select(
        "repo", "rel_path", F.col("f.lines").alias("lines"),
        F.col("f.cyclomaticComplexity").alias("complexity"), F.col("f.fanIn").alias("fan_in"),
        F.col("f.exportCount").alias("export_count"), F.col("f.touchCount").alias("touch_count"),
        F.to_timestamp("createdAt").alias("created_at"), F.col("toolVersion").alias("tool_version"))
