"""History at any number of dates (A2, J3): counts cumulated per path and date,
and an as-of join that gives each date the counts before it.

The events are read once, whatever the number of dates: what a commit or an
importer adds to a path counts from its first date on, so each path has one row
per date on which something was added, and its counts up to then. A snapshot's
date finds the last such row before it by sorting both together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def cumulative_counts(events: DataFrame, members: dict[str, str], keys=("repo",), path: str = "path", at: str = "committed_at") -> DataFrame:
    """``keys…, path, at, <name>…``: for each name in ``members`` how many different
    values of its column the path had up to and including that date. Nulls count nowhere.

    First dates are a two-phase minimum per (path, value), so a path that a
    third of all events touch sends each value once per task; what is sorted per path
    is its dates, not its events.
    """
    keys = list(keys)
    given = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in members.items()]))
    first = events.select(*keys, path, at, given.alias("g")).filter(F.col("g.value").isNotNull() & F.col(at).isNotNull()).groupBy(
        *keys, path, "g.name", "g.value").agg(F.min(at).alias(at))
    added = first.groupBy(*keys, path, at).agg(*[F.count_if(F.col("name") == n).alias(n) for n in members])
    upto = Window.partitionBy(*keys, path).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return added.select(*keys, path, at, *[F.sum(n).over(upto).alias(n) for n in members])


def as_of(points: DataFrame, history: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``points`` with the ``values`` of the last ``history`` row strictly before each
    point's ``at``, null where there is none. One shuffle: both sides are sorted together by key and time."""
    own = points.columns
    both = points.select("*", F.lit(0).alias("_kind"), *[F.lit(None).cast(history.schema[v].dataType).alias(f"_{v}") for v in values]).unionByName(
        history.select(*by, at, F.lit(1).alias("_kind"), *[F.col(v).alias(f"_{v}") for v in values]), allowMissingColumns=True)
    # At the same time a point comes first, so it doesn't see what happens then.
    before = Window.partitionBy(*by).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("*", *[F.last(f"_{v}", ignorenulls=True).over(before).alias(v) for v in values]).filter("_kind = 0").select(*own, *values)


def deltas_over_dates(cumulated: DataFrame, files: DataFrame, dates: DataFrame, counts: list[str], keys=("repo",), path: str = "path",
                      at: str = "committed_at") -> DataFrame:
    """``keys…, path, at, <count>, <count>_delta, is_new`` of every file for every
    date of its repository (``dates``: ``keys…, at``): the counts before that date,
    what was added since, and whether there was nothing before."""
    keys = list(keys)
    points = files.select(*keys, path).join(dates.select(*keys, at), keys)
    then = as_of(points, cumulated, [*keys, path], at, counts)
    now = cumulated.groupBy(*keys, path).agg(*[F.max(c).alias(f"_now_{c}") for c in counts])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return then.join(now, [*keys, path], "left").select(
        *keys, path, at, *[zero(c).alias(c) for c in counts], *[(zero(f"_now_{c}") - zero(c)).alias(f"{c}_delta") for c in counts],
        F.col(counts[0]).isNull().alias("is_new"))
