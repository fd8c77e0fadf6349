"""Streaming gate (ST1): each arriving batch of changed files is selected
(F7), measured (P1-P5) and labelled (F5), append-only.

Three ways out: status rows per file (stateless), status and verdict parts per
micro-batch, or one final verdict per commit, which keeps state: changes that
were seen, and the open commits' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from faultline.operators import candidates as C
from pyspark.sql import functions as F

from faultline.operators.gate import changed_files, gate_status, gate_verdict
from faultline.operators.metric_store import measured_changes, measured_files
from faultline.operators.metrics import file_metrics
from faultline.schemas import STAGED_CHANGES, TIMED_CHANGES
from faultline.session import checkpoint_path


def gate_stream_frame(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                      min_lines: int = C.DEFAULT_MIN_LINES,
                      min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, strict=False,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """The streaming DataFrame of gate rows over a file source."""
    reader = spark.readStream.schema(STAGED_CHANGES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.load(source_dir)
    m = file_metrics(changed_files(changes), keys=("repo", "commit_id"))
    return gate_status(m, min_lines, min_complexity, strict)


def start_gate_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                      name: str = "gate", fmt: str = "parquet", sink_fmt: str = "parquet",
                      available_now: bool = False, **kw) -> StreamingQuery:
    """Start the gate stream. Its checkpoint lives under the session's shared
    ``spark.checkpoint.dir``, so a restarted job resumes where it stopped."""
    df = gate_stream_frame(spark, source_dir, fmt, **kw)
    w = (df.writeStream.outputMode("append").format(sink_fmt)
         .option("checkpointLocation", checkpoint_path(spark, f"stream-{name}"))
         .option("path", sink_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def gate_batch(changes: DataFrame, min_lines: int = C.DEFAULT_MIN_LINES,
               min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, strict=False) -> DataFrame:
    """Gate rows of one micro-batch of changes. A content that several of them hold is parsed once."""
    m = measured_files(changed_files(changes), keys=("repo", "commit_id"))
    return gate_status(m, min_lines, min_complexity, strict)


def write_gate_batch(status: DataFrame, batch_id: int, sink_dir: str, verdict_dir: str,
                     fmt: str = "parquet") -> None:
    """One micro-batch: per-file status rows and the verdict of each commit
    in the batch (F6), both under ``batch_id=<n>``. Overwriting that partition
    makes a retried batch idempotent."""
    status = status.persist()
    try:
        tagged = status.withColumn("batch_id", F.lit(batch_id))
        (tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").format(fmt).save(sink_dir))
        verdict = gate_verdict(status, keys=("repo", "commit_id")).withColumn("batch_id", F.lit(batch_id))
        (verdict.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").format(fmt).save(verdict_dir))
    finally:
        status.unpersist()


def start_gate_verdict_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                              verdict_dir: str, name: str = "gate-verdict", fmt: str = "parquet",
                              available_now: bool = False, min_lines: int = C.DEFAULT_MIN_LINES,
                              min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, strict=False,
                              max_files_per_trigger: int | None = None) -> StreamingQuery:
    """The gate stream with a verdict of each commit in every micro-batch. A commit
    whose files arrive in several batches has a part in each;
    :func:`read_gate_verdicts` merges them."""
    reader = spark.readStream.schema(STAGED_CHANGES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (reader.load(source_dir).writeStream.option("checkpointLocation", checkpoint_path(spark, f"stream-{name}"))
         .foreachBatch(lambda b, i: write_gate_batch(gate_batch(b, min_lines, min_complexity, strict), i, sink_dir, verdict_dir)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_gate_verdicts(spark: SparkSession, verdict_dir: str, fmt: str = "parquet") -> DataFrame:
    """One verdict per commit over all batches so far: counts add up, and a commit
    fails if it failed in any batch. Empty before the first batch."""
    schema = "repo string, commit_id string, n_checked long, n_flagged long, failed boolean"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(verdict_dir)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(verdict_dir).groupBy("repo", "commit_id").agg(
        F.sum("n_checked").alias("n_checked"), F.sum("n_flagged").alias("n_flagged"), F.bool_or("failed").alias("failed"))


def commit_verdicts(changes: DataFrame, quiet: str = "10 minutes", late: str = "1 hour",
                    min_lines: int = C.DEFAULT_MIN_LINES, min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, strict=False) -> DataFrame:
    """``repo, commit_id, closed_at, n_checked, n_flagged, failed`` of a stream of
    ``TIMED_CHANGES``: one row per commit, once, when it closes.

    A commit closes when no change of it came for ``quiet`` and the watermark
    (``late`` behind the newest change) has passed that; a change that is staged again
    within ``late`` counts once. A content that several changes of a micro-batch hold is
    parsed once. State is the keys of changes not yet past the
    watermark and one session per open commit, both spread by their keys; what a
    commit's micro-batches hold is combined before the shuffle. The last commits of a
    stream that falls silent stay open until a later change moves the watermark on.
    """
    seen = changed_files(changes.withWatermark("staged_at", late)).dropDuplicatesWithinWatermark(["repo", "commit_id", "path"])
    m = measured_changes(seen, keys=("repo", "commit_id", "staged_at"))
    st = gate_status(m, min_lines, min_complexity, strict)
    sessions = st.groupBy("repo", "commit_id", F.session_window("staged_at", quiet).alias("session")).agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("flagged")).alias("n_flagged"),
        F.coalesce(F.bool_or(F.col("flagged") & F.col("strict")), F.lit(False)).alias("failed"))
    return sessions.select("repo", "commit_id", F.col("session.end").alias("closed_at"), "n_checked", "n_flagged", "failed")


def start_commit_verdict_stream(spark: SparkSession, source_dir: str, verdict_dir: str, name: str = "commit-verdict",
                                fmt: str = "parquet", sink_fmt: str = "parquet", available_now: bool = False,
                                max_files_per_trigger: int | None = None, **kw) -> StreamingQuery:
    """Final verdicts of the changes that arrive in ``source_dir`` (schema
    ``TIMED_CHANGES``), appended to ``verdict_dir``. Each file and each verdict is read
    and written once, also over restarts; readers of ``verdict_dir`` aggregate nothing."""
    reader = spark.readStream.schema(TIMED_CHANGES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (commit_verdicts(reader.load(source_dir), **kw).writeStream.outputMode("append").format(sink_fmt)
         .option("checkpointLocation", checkpoint_path(spark, f"stream-{name}")).option("path", verdict_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
