"""Outlier score (P6), ranking (T1) and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Score weights (fixed values): complexity x2, lines x0.1, fan-in x3, touches x2.


def outlier_score(complexity="complexity", lines="lines", fan_in="fan_in",
                  touch_count="touch_count") -> Column:
    """``complexity*2 + lines*0.1 + fan_in*3 + touches*2`` as a double.

    Same operand order as the reference so the double is bit-equal; a null
    ``touch_count`` (no history) contributes 0.
    """
    c, l, f, t = (F.col(x) if isinstance(x, str) else x
                  for x in (complexity, lines, fan_in, touch_count))
    return c * 2 + l * F.lit(0.1) + f * 3 + F.coalesce(t * 2, F.lit(0).cast("long"))


def with_score(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, outlier_score())


def rank_order(score: str = "score", tiebreak=("path",)) -> list[Column]:
    """Descending score; ties broken by ``tiebreak`` ascending (a total order)."""
    return [F.col(score).desc()] + [F.col(c).asc() for c in tiebreak]


def top_k(df: DataFrame, k: int, score: str = "score", tiebreak=("path",),
          rank: str | None = "rank") -> DataFrame:
    """The ``k`` highest-scoring rows of the whole table (``k > n`` gives n).

    ``orderBy().limit(k)`` is planned as TakeOrderedAndProject: every task keeps
    its own k best rows, so only ``k × tasks`` rows ever meet in one place.
    """
    if k < 0:
        raise ValueError(f"top-k needs k >= 0, got {k}")
    out = df.orderBy(*rank_order(score, tiebreak)).limit(k)
    if rank:
        # k rows at most: numbering them in one partition is bounded by k.
        out = out.withColumn(rank, F.row_number().over(
            Window.orderBy(*rank_order(score, tiebreak))).cast("long"))
    return out


def top_k_per_group(df: DataFrame, k: int, keys=("repo",), score: str = "score",
                    tiebreak=("path",), rank: str = "rank") -> DataFrame:
    """The ``k`` highest-scoring rows per group.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so a group holding a third of all rows sends at most k rows per
    map task to its reducer.
    """
    if k < 0:
        raise ValueError(f"top-k needs k >= 0, got {k}")
    w = Window.partitionBy(*keys).orderBy(*rank_order(score, tiebreak))
    # Filter on the window's own column (so the optimizer inserts the partial
    # WindowGroupLimit), then widen the rank to bigint.
    return (df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
            .withColumn(rank, F.col(rank).cast("long")))
