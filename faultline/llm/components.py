"""Connected components of a link table by alternating large and small stars.

Each round is two grouped minima and two joins on the links alone; a node that
holds many links is an ordinary join key, which adaptive execution splits. The
number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.llm._shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached; nodes without
    links have no row.

    ``edges`` has two bigint columns a and b, in any order; loops, repeats and
    nulls are allowed and ignored.
    """
    at = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    while True:
        at = stored(_star(_star(at, large=True), large=False), "stars")
        # The links form a star forest when a round changes nothing.
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now
