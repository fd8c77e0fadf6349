"""End-to-end jobs (E1-E5) on a temporary source tree, commit log and answers."""

import json
import os

from pyspark.sql import functions as F

from faultline.plans import jobs
from faultline.sources import answers as A, baseline_store as BS
from faultline.sources.history_log import history_repos, read_commit_log
from faultline.sources.source_tree import read_source_tree


def write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def big(name, n_if=9, pad=90):
    ifs = "\n".join(f"  if (x > {i}) {{ y += {i}; }}" for i in range(n_if))
    return (f'import {{ util }} from "./util";\nexport function {name}(x: number) {{\n'
            f"  let y = util();\n{ifs}\n  return y;\n}}\n" + "// pad\n" * pad)


def tree(root):
    write(root, "src/util.ts", "export function util() { return 1; }\n")
    write(root, "src/a.ts", big("alpha"))
    write(root, "src/b.ts", big("beta", n_if=2, pad=5))
    write(root, "src/broken.ts", 'export function broken( {\n  if (true {\n  "open\n')
    write(root, "src/dir/index.ts", "export const d = 1;\n")
    write(root, "src/c.ts", 'import { d } from "./dir.js";\nimport { e } from "./dir";\nexport const c = d;\n')


def test_scan_baseline_drift_gate(spark, tmp_dir):
    root = os.path.join(tmp_dir, "repo")
    tree(root)
    logs = os.path.join(tmp_dir, "logs")
    write(logs, "r.log", "src/a.ts\nsrc/b.ts\n\nsrc/a.ts\n\nsrc/a.ts\nsrc/util.ts\n")
    files = read_source_tree(spark, root, repo="r")
    roots = spark.createDataFrame([("r", os.path.realpath(root))], "repo string, git_root string")
    commits = read_commit_log(spark, logs, git_root=roots)
    scored = jobs.scored_files(files, commits, history_repos(spark, logs))
    by = {r.rel_path: r for r in scored.collect()}
    assert by["src/util.ts"].fan_in == 2 and by["src/dir/index.ts"].fan_in == 1   # ./dir.js is not dir/index
    assert by["src/a.ts"].touch_count == 3 and by["src/c.ts"].touch_count == 0
    assert by["src/broken.ts"].has_syntax_errors

    # E1 without a baseline: top 2 per repo, display columns, totals
    res = jobs.scan_report(scored, None, k=2)
    top = res.top.orderBy("rank").collect()
    # util.ts: 1*2 + 2*0.1 + 2*3 + 1*2 = 10.2 beats broken.ts (4.4) and b.ts (9.4)
    assert [r.rel_path for r in top] == ["src/a.ts", "src/util.ts"]
    assert top[0].touches == "3" and top[0].delta_text == "" and top[0].short_path.endswith("repo/src/a.ts")
    (t,) = res.totals.collect()
    assert (t.files_scanned, t.shown, t.broken, t.has_touch_data) == (6, 2, 1, True)

    # E2 baseline, then E1 against it after a file grows
    bpath = os.path.join(tmp_dir, "baseline")
    BS.save_baseline(jobs.baseline_snapshot(scored, "2026-01-02 00:00:00", "0.1.0"), bpath)
    write(root, "src/b.ts", big("beta", n_if=5, pad=5))
    write(root, "src/new.ts", "export const n = 1;\n")
    files2 = read_source_tree(spark, root, repo="r")
    scored2 = jobs.scored_files(files2, commits, history_repos(spark, logs))
    base = BS.load_baseline(spark, bpath)
    assert sorted(r.rel_path for r in base.collect())[:2] == ["src/a.ts", "src/b.ts"]
    res2 = jobs.scan_report(scored2, base, k=10)
    got = {r.rel_path: r.delta_text for r in res2.top.collect()}
    assert got["src/b.ts"] == "Δcomplexity=+3 Δlines=+3" and got["src/new.ts"] == "NEW"
    assert got["src/a.ts"] == "Δcomplexity=±0 Δlines=±0"
    assert res2.totals.collect()[0].baseline_date == "2026-01-02"

    # Broken excluded, top 2, thresholds 80 lines / complexity 8
    prompts = jobs.drift_prompts(scored2, files2, k=2).collect()
    assert [p.rel_path for p in prompts] == ["src/a.ts"]
    assert '"alpha"' in prompts[0].prompt and "Git touch count: 3 commit(s)" in prompts[0].prompt

    # Answers joined to candidates; a missing answer is an error row
    cands = jobs.drift_prompts(scored2, files2, k=3, min_lines=1, min_complexity=1).drop("prompt")
    a_path = [r.path for r in cands.collect() if r.rel_path == "src/a.ts"][0]
    answer = {"inferredOriginalPurpose": "p", "currentResponsibilities": ["x"], "hasDrifted": True,
              "driftSummary": "s", "suggestedSplit": [
                  {"newFileName": "a1.ts", "responsibility": "r", "movedExports": ["alpha", "util"]}]}
    responses = spark.createDataFrame([("r", a_path, json.dumps(answer))], "repo string, path string, raw_text string")
    analyses, summary = jobs.drift_results(cands, responses)
    rows = {r.rel_path: r for r in analyses.collect()}
    assert not rows["src/a.ts"].is_error
    assert rows["src/a.ts"].warnings[0].startswith("1 suggested symbol(s) are IMPORTED") and "util" in rows["src/a.ts"].warnings[0]
    others = [r for k, r in rows.items() if k != "src/a.ts"]
    assert others and all(r.is_error and r.drift_summary.startswith("Analysis failed: No model answer") for r in others)
    (s,) = summary.collect()
    assert s.analyzed == len(rows) and s.errored == len(others) and not s.all_failed

    # Structured records, all fields including warnings
    out = os.path.join(tmp_dir, "analyses")
    A.write_analyses(analyses.select("repo", "path", "is_error", "drift_summary", "warnings"), out)
    back = spark.read.json(out).filter(~F.col("is_error")).collect()
    assert back[0].warnings == rows["src/a.ts"].warnings

    # E5: gate over a change set
    changes = files2.select("repo", F.lit("c1").alias("commit_id"), F.lit("M").alias("status"),
                            "rel_path", "content").withColumnRenamed("rel_path", "path")
    status, verdict = jobs.gate(changes, strict=True)
    flagged = sorted(r.path for r in status.filter("flagged").collect())
    assert flagged == ["src/a.ts"]
    assert verdict.collect()[0].failed is True


def test_touches_meet_by_match_keys(spark):
    files = spark.createDataFrame([("r", "C:/Work/App/main.ts", "export const a = 1;"), ("q", "/w/b.ts", "export const b = 1;"),
                                   ("none", "/n/c.ts", "")], "repo string, path string, content string")
    commits = spark.createDataFrame([("r", "/c/work/app/Main.ts"), ("r", "c:\\work\\app\\main.ts"), ("q", "/w/readme.md")], "repo string, path string")
    exact = {r.repo: r.touch_count for r in jobs.scored_files(files, commits).collect()}
    folded = {r.repo: r.touch_count for r in jobs.scored_files(files, commits, case_insensitive=True).collect()}
    # a repository whose history touches no source file has 0, one without history null
    assert exact == {"r": 0, "q": 0, "none": None} and folded == {"r": 2, "q": 0, "none": None}


def test_empty_logs_are_history(spark, tmp_dir):
    write(tmp_dir, "x.log", "")
    write(tmp_dir, "repo=_y/history.txt", "src/a.ts\n")
    assert sorted(r.repo for r in history_repos(spark, tmp_dir).collect()) == ["_y", "x"]
    assert [(r.repo, r.path) for r in read_commit_log(spark, tmp_dir).collect()] == [("_y", "src/a.ts")]


def test_prompts_open_only_the_candidates(spark, tmp_dir):
    root = os.path.join(tmp_dir, "repo")
    tree(root)
    scored = jobs.scored_files(read_source_tree(spark, root, repo="r"))
    scored = scored.cache()
    want = [r.prompt for r in jobs.drift_prompts(scored, read_source_tree(spark, root, repo="r"), k=2).collect()]
    for name in ("b.ts", "c.ts", "util.ts"):  # not candidates: they need not be there any more
        os.truncate(os.path.join(root, "src", name), 0)
    got = jobs.drift_prompts(scored, root, k=2).collect()
    assert [r.prompt for r in got] == want and len(want) == 1


def test_stores_by_arrow_schemes():
    from faultline.sources.source_tree import arrow_uri
    assert arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and arrow_uri("hdfs://h:1/a") == "hdfs://h:1/a" and arrow_uri("gs://b/c") == "gs://b/c"
