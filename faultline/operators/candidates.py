"""Drift candidates: drop unparseable files (F3), take the top k (T3), then
apply the size-and-complexity eligibility (F4) — in that order, so fewer than
k candidates may remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.filters import parseable
from faultline.operators.scoring import top_k, top_k_per_group

# Defaults (fixed values): top 5, at least 80 lines and complexity 8.
DEFAULT_TOP = 5
DEFAULT_MIN_LINES = 80
DEFAULT_MIN_COMPLEXITY = 8


def eligible(min_lines: int = DEFAULT_MIN_LINES,
             min_complexity: int = DEFAULT_MIN_COMPLEXITY) -> Column:
    return (F.col("lines") >= min_lines) & (F.col("complexity") >= min_complexity)


def drift_candidates(scored: DataFrame, k: int = DEFAULT_TOP,
                     min_lines: int = DEFAULT_MIN_LINES,
                     min_complexity: int = DEFAULT_MIN_COMPLEXITY,
                     keys=None, tiebreak=("path",)) -> DataFrame:
    """The top-k parseable rows with ``rank``, ``eligible`` and ``status``
    (``candidate`` or ``skipped_small``). ``keys`` gives a top-k per group."""
    whole = parseable(scored)
    top = (top_k(whole, k, tiebreak=tiebreak) if not keys
           else top_k_per_group(whole, k, keys=keys, tiebreak=tiebreak))
    el = eligible(min_lines, min_complexity)
    return (top.withColumn("eligible", el)
            .withColumn("status", F.when(el, "candidate").otherwise("skipped_small")))


def classify_all(scored: DataFrame, top: DataFrame, keys=(), path: str = "path") -> DataFrame:
    """Every row with its drift status: broken, beyond_top, skipped_small or
    candidate (the complement sets the reference reports)."""
    t = top.select(*keys, path, "rank", F.col("status").alias("_top_status"))
    out = scored.join(t, [*keys, path], "left")
    status = (F.when(F.col("has_syntax_errors"), "broken")
              .when(F.col("_top_status").isNull(), "beyond_top")
              .otherwise(F.col("_top_status")))
    return out.withColumn("status", status).drop("_top_status")
