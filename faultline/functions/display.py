"""Display columns of the scan table: P7, P12, P13, P15."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display_score(score="score") -> Column:
    """Score rounded half up, as an integer (scores are never negative)."""
    return F.round(_c(score)).cast("int")


def delta_label(delta) -> Column:
    """``±0`` for zero, ``+n`` above, ``-n`` below."""
    d = _c(delta)
    return (F.when(d == 0, F.lit("±0"))
            .when(d > 0, F.concat(F.lit("+"), d.cast("string")))
            .otherwise(d.cast("string")))


def delta_text(is_new="is_new", complexity_delta="complexity_delta",
               lines_delta="lines_delta", has_baseline="has_baseline") -> Column:
    """``NEW`` / ``Δcomplexity=+3 Δlines=+5`` / empty when there is no baseline."""
    text = F.when(_c(is_new), F.lit("NEW")).otherwise(F.concat(
        F.lit("Δcomplexity="), delta_label(complexity_delta),
        F.lit(" Δlines="), delta_label(lines_delta)))
    return F.when(_c(has_baseline), text).otherwise(F.lit(""))


def touch_display(touch_count="touch_count") -> Column:
    """Touch count as text; ``?`` when the repository has no history."""
    return F.coalesce(_c(touch_count).cast("string"), F.lit("?"))


def date_label(created_at="created_at") -> Column:
    """Date part of a baseline's creation time."""
    return F.date_format(_c(created_at), "yyyy-MM-dd")
