"""Structural gate: per-file status (F5), batch verdict (F6), changed-file
selection (F7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.candidates import DEFAULT_MIN_COMPLEXITY, DEFAULT_MIN_LINES

# Change statuses the gate checks: added, copied, modified (fixed values).
CHECKED_STATUSES = ["A", "C", "M"]
TS_FILE = r"\.(ts|tsx)$"


def changed_files(changes: DataFrame, status: str = "status", path: str = "path") -> DataFrame:
    """Added/copied/modified ``.ts``/``.tsx`` files of a change set."""
    return changes.filter(F.col(status).isin(CHECKED_STATUSES) & F.col(path).rlike(TS_FILE))


def _strict_col(strict) -> Column:
    if isinstance(strict, bool):
        return F.lit(strict)
    return F.col(strict) if isinstance(strict, str) else strict


def gate_status(metrics: DataFrame, min_lines: int = DEFAULT_MIN_LINES,
                min_complexity: int = DEFAULT_MIN_COMPLEXITY, strict=False,
                path: str = "path") -> DataFrame:
    """Adds ``flagged``, ``strict``, ``status`` (OK/WARN/FAIL) and ``message``.

    Strict mode changes the label, not the data. ``strict`` may be a column
    (a per-repository policy).
    """
    flagged = (F.col("lines") >= min_lines) & (F.col("complexity") >= min_complexity)
    st = _strict_col(strict)
    status = F.when(flagged, F.when(st, "FAIL").otherwise("WARN")).otherwise("OK")
    p = F.col(path).cast("string")
    counts = F.concat(F.lit("(lines="), F.col("lines").cast("string"), F.lit(", complexity="),
                      F.col("complexity").cast("string"), F.lit(")"))
    message = F.concat(status, F.lit("  "), p, F.lit("  "), counts,
                       F.when(flagged, F.lit(" — big/complex enough to warrant a look."))
                       .otherwise(F.lit("")))
    return (metrics.withColumn("flagged", flagged).withColumn("strict", st)
            .withColumn("status", status).withColumn("message", message))


def gate_verdict(gated: DataFrame, keys=("repo",)) -> DataFrame:
    """Per batch: files checked, files flagged, and ``failed`` — true iff some
    flagged file is under strict mode."""
    return gated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(F.col("flagged")).alias("n_flagged"),
        F.coalesce(F.bool_or(F.col("flagged") & F.col("strict")), F.lit(False)).alias("failed"))
