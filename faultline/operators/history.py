"""Touch history: path filter (F2), touch counts (A2), attach (J2), any-touch (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# History lines kept: TypeScript files outside node_modules (fixed values).
HISTORY_INCLUDE = r"\.(ts|tsx)$"
HISTORY_EXCLUDE_SUBSTRING = "node_modules/"


def history_path_filter(commit_files: DataFrame, path: str = "path") -> DataFrame:
    """Trimmed, non-blank ``.ts``/``.tsx`` paths not under ``node_modules/``.

    Unlike the scan rules this does not apply the full ignore list.
    """
    p = F.trim(F.col(path))
    return (commit_files.withColumn(path, p)
            .filter((F.col(path) != "") & F.col(path).rlike(HISTORY_INCLUDE)
                    & ~F.col(path).contains(HISTORY_EXCLUDE_SUBSTRING)))


def touch_frequency(commit_files: DataFrame, keys=("repo",), path: str = "path",
                    commit: str | None = "commit_id") -> DataFrame:
    """``(keys…, path, touches)``: commits that list each path.

    With ``commit`` given, a commit that repeats a path counts once (git log
    lists a file once per commit). Partial aggregation runs map-side, so a hot
    path costs one row per map task in the shuffle.
    """
    keys = list(keys)
    agg = (F.count_distinct(commit) if commit else F.count(F.lit(1))).alias("touches")
    return commit_files.groupBy(*keys, path).agg(agg)


def attach_touches(files: DataFrame, touches: DataFrame, keys=("repo",),
                   path: str = "path", history_repos: DataFrame | None = None,
                   history_keys=None, has_history: bool = True) -> DataFrame:
    """``files`` plus nullable ``touch_count``.

    ``touch_count`` is null for every file of a repository without history and
    0 for an untouched file of a repository with history. ``history_repos``
    lists the repositories whose history was exported (by ``history_keys``,
    default ``keys``); without it, ``has_history`` applies to all rows.
    """
    keys = list(keys)
    hkeys = list(keys if history_keys is None else history_keys)
    t = touches.select(*keys, path, F.col("touches").cast("long").alias("_t"))
    out = files.join(t, [*keys, path], "left")
    if history_repos is not None:
        h = history_repos.select(*hkeys).distinct().withColumn("_hist", F.lit(True))
        out = out.join(h, hkeys, "left")
        hist = F.coalesce(F.col("_hist"), F.lit(False))
    else:
        hist = F.lit(has_history)
    touch = F.when(hist, F.coalesce(F.col("_t"), F.lit(0).cast("long"))).otherwise(
        F.lit(None).cast("long"))
    return out.select(*[c for c in out.columns if c not in ("_t", "_hist")],
                      touch.alias("touch_count"))


def any_touch(scored: DataFrame, keys=("repo",)) -> DataFrame:
    """Per repository: does any file carry touch data (drives the touches column)."""
    return scored.groupBy(*keys).agg(
        F.max(F.col("touch_count").isNotNull()).alias("has_touch_data"))
