"""Spark session helpers.

Every job in this package is a plain DataFrame transformation; the only
session-level decisions are the ones that matter at scale:

* AQE on, with skew-join splitting and partition coalescing, so hot keys in a
  join are split at run time and tiny shuffles are merged.
* Broadcast joins only below Spark's measured-size threshold
  (``autoBroadcastJoinThreshold`` at plan time, the AQE variant at run time);
  the one hint (prompt candidates, ``plans/jobs.py``) stands behind a count.
* UI off (no server), UTC session time zone (the oracle is UTC-naive).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "faultline",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and streaming state, as
    ``spark.checkpoint.dir`` names it.

    A session on a cluster without that setting is an error: a folder of the
    driver's own would be lost to the executors and to a restarted job. Only a
    local session (tests) gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what is built on
    it reads the table instead of repeating the work, also after a lost executor."""
    at = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
