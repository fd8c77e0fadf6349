"""User-level jobs (E1-E5), composed from the operators. Each returns DataFrames.
A scan, the candidates of a prompt job and paired answers are written to the
shared folder while a job is put together; what comes after them runs when the
caller writes or collects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from faultline.functions import display, paths
from faultline.functions.prompt import build_prompt
from faultline.operators import baseline as BL, candidates as C, gate as G, history as H
from faultline.operators import scoring as S, validation as V
from faultline.operators.metric_store import measured_files
from faultline.operators.metrics import scan
from faultline.session import stored
from faultline.sources.source_tree import read_contents

DEFAULT_SCAN_TOP = 25
#: Candidate rows (a few hundred bytes each) that may be broadcast.
SENT = 20_000


@dataclass
class ScanResult:
    scored: DataFrame    # every file, scored, with deltas
    top: DataFrame       # top-k per repository with display columns
    totals: DataFrame    # per repository: scanned, shown, broken, touch flag


def scored_files(source_files: DataFrame, commit_files: DataFrame | None = None,
                 history_repos: DataFrame | None = None, keys=("repo",),
                 case_insensitive: bool | str = False, store: str | None = None) -> DataFrame:
    """S1 rows -> metrics, fan-in (J1, A1), touches (A2, J2) and score.

    ``commit_files`` holds ``keys…, path`` per listed file (``commit_id`` when
    present de-duplicates repeats). Paths meet by their match keys (P9, P10):
    drive prefixes and slashes as one spelling, and case ignored for
    repositories of a case-insensitive host (a flag, or the name of a boolean
    column of both tables). The history filter (F2) applies here, so a
    repository whose history touches no source file counts as touched 0 times.
    Repositories absent from ``history_repos`` (by default, from the commits)
    get null touches; without history at all every touch is null. ``store`` keeps
    metrics by content from one snapshot to the next.
    """
    flag = [case_insensitive] if isinstance(case_insensitive, str) else []
    m = scan(source_files, keys=keys, store=store)
    if commit_files is None:
        return S.with_score(m.withColumn("touch_count", F.lit(None).cast("long")))
    if flag:
        m = m.join(source_files.select(*keys, "path", *flag), [*keys, "path"])
    match = paths.path_key(paths.drive_path("path"), F.col(flag[0]) if flag else case_insensitive)
    commit = "commit_id" if "commit_id" in commit_files.columns else None
    listed = H.history_path_filter(commit_files).withColumn("_match", match)
    t = H.touch_frequency(listed, keys=keys, path="_match", commit=commit)
    hist = history_repos if history_repos is not None else commit_files.select(*keys)
    scored = H.attach_touches(m.withColumn("_match", match), t, keys=keys, path="_match", history_repos=hist)
    return S.with_score(scored.drop("_match", *flag))


def scan_report(scored: DataFrame, baseline: DataFrame | None = None,
                k: int = DEFAULT_SCAN_TOP, keys=("repo",), rel_path: str = "rel_path") -> ScanResult:
    """Per repository, the k top outliers with display columns, plus totals."""
    if k < 0:
        raise ValueError("top must be a non-negative integer")
    d = BL.delta_vs_baseline(scored, baseline, keys=keys, rel_path=rel_path)
    top = S.top_k_per_group(d, k, keys=keys)
    flags = H.any_touch(scored, keys=keys)
    top = top.join(flags, list(keys), "left").select(
        "*", display.display_score("score").alias("display_score"),
        F.when(F.col("has_touch_data"), display.touch_display("touch_count")).alias("touches"),
        F.size("exported_symbols").alias("export_count"),
        paths.short_path(F.col("path").cast("string")).alias("short_path"))
    totals = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.least(F.count(F.lit(1)), F.lit(k)).alias("shown"),
        F.count_if("has_syntax_errors").alias("broken"),
        F.max(F.col("touch_count").isNotNull()).alias("has_touch_data"))
    if baseline is not None:
        dates = baseline.groupBy(*keys).agg(display.date_label(F.max("created_at")).alias("baseline_date"))
        totals = totals.join(dates, list(keys), "left")
    return ScanResult(d, top, totals)


def baseline_snapshot(scored: DataFrame, created_at, tool_version: str, keys=("repo",),
                      root: str | None = None) -> DataFrame:
    """Every scanned file as a baseline row under its relative key (write
    with ``sources.baseline_store.save_baseline``)."""
    return BL.baseline_rows(scored, created_at, tool_version, keys=keys, root=root)


def drift_prompts(scored: DataFrame, source_files: DataFrame | str, k: int = C.DEFAULT_TOP,
                  min_lines: int = C.DEFAULT_MIN_LINES,
                  min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, keys=("repo",)) -> DataFrame:
    """Drop broken files, take the top k per repository, apply the
    thresholds, and build the analysis prompt of each remaining candidate.

    ``source_files`` is the root of the tree that was scanned, of which then only
    the candidates' files are opened, or a table with the contents. The
    candidates are stored first. Up to ``SENT`` of them (k for each of
    many repositories) are sent to a table's contents, so those aren't shuffled;
    beyond that both sides meet in a shuffle."""
    cand = C.drift_candidates(scored, k, min_lines, min_complexity, keys=keys)
    chosen = stored(cand.filter(F.col("status") == "candidate"), "drift-candidates")
    if isinstance(source_files, str):
        found = read_contents(scored.sparkSession, source_files, chosen)
    else:
        src = source_files.select(*keys, "path", "content")
        few = chosen.count() <= SENT
        found = src.join(F.broadcast(chosen) if few else chosen, [*keys, "path"]).select(*chosen.columns, "content")
    return found.withColumn("prompt", build_prompt("path", "exported_symbols", "content", "touch_count")).drop("content")


def drift_results(candidates: DataFrame, responses: DataFrame, keys=("repo",)):
    """Pair each candidate with its answer (J5), validate (X1-X8) and
    summarise (A6, A7). Returns (analyses, summary)."""
    paired = V.pair_answers(candidates, responses, keys=keys)
    analyses = V.validate_paired(paired)
    return analyses, V.drift_summary(analyses, keys=keys)


def gate(changes: DataFrame, min_lines: int = C.DEFAULT_MIN_LINES,
         min_complexity: int = C.DEFAULT_MIN_COMPLEXITY, strict=False,
         keys=("repo", "commit_id")):
    """E5: changed TypeScript files (F7) -> metrics -> status (F5) -> verdict
    per commit (F6). Returns (per-file status, per-batch verdict). A content that
    several changes hold is parsed once."""
    files = G.changed_files(changes)
    m = measured_files(files, keys=keys)
    st = G.gate_status(m, min_lines, min_complexity, strict)
    return st, G.gate_verdict(st, keys=keys)
