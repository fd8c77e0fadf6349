"""Baseline snapshot rows (E2 / P11) and the delta against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.display import delta_text
from faultline.functions.paths import relative_key


def baseline_rows(scored: DataFrame, created_at: Column | str, tool_version: str,
                  keys=("repo",), path: str = "path", root: str | None = None) -> DataFrame:
    """One baseline row per file — every file, never a top-N.

    Keys are relative, so a baseline is portable across machines: the scan's
    ``rel_path`` column, or the path relative to the per-row ``root`` column
    when given. Without either they can't be told, which is an error.
    ``export_count`` is the number of exports.
    """
    if not root and "rel_path" not in scored.columns:
        raise ValueError("baseline keys are relative: rows need a rel_path column, or name their root column")
    rel = relative_key(path, root) if root else F.col("rel_path")
    ts = F.lit(created_at).cast("timestamp") if isinstance(created_at, str) else created_at
    return scored.select(
        *keys, rel.alias("rel_path"), "lines", "complexity",
        F.col("fan_in").cast("long").alias("fan_in"),
        F.size("exported_symbols").alias("export_count"),
        F.col("touch_count").cast("long").alias("touch_count"),
        ts.alias("created_at"), F.lit(tool_version).alias("tool_version"))


def delta_vs_baseline(current: DataFrame, baseline: DataFrame | None, keys=("repo",),
                      rel_path: str = "rel_path") -> DataFrame:
    """``current`` plus ``lines_delta, complexity_delta, fan_in_delta, is_new,
    has_baseline, delta_text``.

    A file missing from its repository's baseline is new with zero deltas
    (never a null measure); ``is_new`` is decided by a marker column of the
    join. Files deleted since the baseline are not reported (left join from
    ``current``). ``has_baseline`` is false for repositories with no baseline
    at all, whose ``delta_text`` is empty.
    """
    keys = list(keys)
    if baseline is None:
        z = F.lit(0)
        return current.select("*", z.alias("lines_delta"), z.alias("complexity_delta"),
                              z.cast("long").alias("fan_in_delta"), F.lit(False).alias("is_new"),
                              F.lit(False).alias("has_baseline"), F.lit("").alias("delta_text"))
    b = baseline.select(*keys, F.col("rel_path").alias(rel_path),
                        F.col("lines").alias("_b_lines"),
                        F.col("complexity").alias("_b_complexity"),
                        F.col("fan_in").alias("_b_fan_in"), F.lit(True).alias("_in_base"))
    repos = baseline.select(*keys).distinct().withColumn("has_baseline", F.lit(True))
    out = current.join(b, [*keys, rel_path], "left")
    if keys:
        out = (out.join(repos, keys, "left")
               .withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False))))
    else:
        out = out.withColumn("has_baseline", F.lit(True))
    in_base = F.col("_in_base").isNotNull()
    out = out.select(
        *[c for c in out.columns if c not in ("_b_lines", "_b_complexity", "_b_fan_in", "_in_base")],
        (~in_base & F.col("has_baseline")).alias("is_new"),
        F.when(in_base, F.col("lines") - F.col("_b_lines")).otherwise(F.lit(0)).alias("lines_delta"),
        F.when(in_base, F.col("complexity") - F.col("_b_complexity")).otherwise(F.lit(0))
        .alias("complexity_delta"),
        F.when(in_base, F.col("fan_in") - F.col("_b_fan_in")).otherwise(F.lit(0).cast("long"))
        .alias("fan_in_delta"))
    return out.withColumn("delta_text", delta_text())
