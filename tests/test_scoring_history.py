"""Score (P6, P7), touches (A2, J2, S2) and top-k."""

import os

from pyspark.sql import functions as F

from faultline.operators import candidates as C, history as H, scoring as S
from faultline.sources.history_log import history_repos, read_commit_log


def test_score_golden(spark):
    df = spark.createDataFrame([(10, 100, 2, 5), (10, 100, 2, None)],
                               "complexity int, lines int, fan_in long, touch_count long")
    got = [r.s for r in df.select(S.outlier_score().alias("s")).collect()]
    assert got == [46.0, 36.0]


def test_attach_touches_null_count_zero(spark):
    files = spark.createDataFrame([("r", "/repo/a.ts"), ("r", "/repo/untouched.ts"), ("q", "/q/a.ts")],
                                  "repo string, path string")
    touches = spark.createDataFrame([("r", "/repo/a.ts", 7)], "repo string, path string, touches long")
    hist = spark.createDataFrame([("r",)], "repo string")
    got = {r.path: r.touch_count for r in H.attach_touches(files, touches, history_repos=hist).collect()}
    assert got == {"/repo/a.ts": 7, "/repo/untouched.ts": 0, "/q/a.ts": None}


def test_commit_log_counts(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "logs"))
    with open(os.path.join(tmp_dir, "logs", "r.log"), "w") as f:
        f.write("src/a.ts\n  src/b.tsx \n\nsrc/a.ts\nREADME.md\nnode_modules/x/y.ts\n\nsrc/a.ts\n")
    open(os.path.join(tmp_dir, "logs", "empty.log"), "w").close()
    log = read_commit_log(spark, os.path.join(tmp_dir, "logs"), git_root=spark.createDataFrame([("r", "/home/u/r/")], "repo string, git_root string"))
    counts = {r.path: r.touches for r in H.touch_frequency(log, commit=None).collect()}
    assert counts == {"/home/u/r/src/a.ts": 3, "/home/u/r/src/b.tsx": 1}
    repos = sorted(r.repo for r in history_repos(spark, os.path.join(tmp_dir, "logs")).collect())
    assert repos == ["empty", "r"]


def test_top_k_and_ties(spark):
    df = spark.createDataFrame([("r", "b", 5.0), ("r", "a", 5.0), ("r", "c", 9.0), ("s", "d", 1.0)],
                               "repo string, path string, score double")
    assert [r.path for r in S.top_k(df, 3).orderBy("rank").collect()] == ["c", "a", "b"]
    assert S.top_k(df, 10).count() == 4
    per = {(r.repo, r.path): r.rank for r in S.top_k_per_group(df, 1).collect()}
    assert per == {("r", "c"): 1, ("s", "d"): 1}


def test_candidates_limit_before_threshold(spark):
    rows = [("r", "big", 200, 20, False, 99.0), ("r", "broken", 500, 50, True, 500.0),
            ("r", "small", 10, 30, False, 90.0), ("r", "next", 300, 30, False, 10.0)]
    df = spark.createDataFrame(rows, "repo string, path string, lines int, complexity int, "
                                     "has_syntax_errors boolean, score double")
    top = C.drift_candidates(df, k=2)
    got = {r.path: r.status for r in top.collect()}
    assert got == {"big": "candidate", "small": "skipped_small"}   # "next" never considered
    every = {r.path: r.status for r in C.classify_all(df, top).collect()}
    assert every == {"big": "candidate", "small": "skipped_small", "broken": "broken",
                     "next": "beyond_top"}
    assert top.filter(F.col("eligible")).count() == 1


def test_logs_of_any_name_in_byte_ranges(spark, tmp_dir):
    import gzip
    import os
    import random
    from faultline.sources.history_log import CommitLogReader, history_repos, read_commit_log
    rng, want = random.Random(1), {}
    logs = {"_x.log": "", ".github.log": "", "plain.log": "", "repo=deep/2024/part.txt": "", "zip.log.gz": "", "none.log": ""}
    for name, repo in (("_x.log", "_x"), (".github.log", ".github"), ("plain.log", "plain"), ("repo=deep/2024/part.txt", "deep"), ("zip.log.gz", "zip")):
        lines = ["".join(rng.choice("ab/é") for _ in range(rng.choice([0, 1, 3, 40]))) + ".ts" * rng.randrange(2) for _ in range(60)]
        logs[name] = "\n".join(lines) + ("\n" if rng.random() < 0.5 else "\r\n  src/last.tsx")
        want[repo] = sorted(x.strip() for x in logs[name].split("\n") if x.strip())
    for name, text in logs.items():
        at = os.path.join(tmp_dir, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with (gzip.open if name.endswith("gz") else open)(at, "wb") as f:
            f.write(text.encode())
    open(os.path.join(tmp_dir, "_SUCCESS"), "w").close()
    df = read_commit_log(spark, tmp_dir, apply_filter=False, split_bytes=300)
    got = {}
    for r in df.collect():
        got.setdefault(r.repo, []).append(r.path)
    assert {k: sorted(v) for k, v in got.items()} == want and df.rdd.getNumPartitions() > 10
    for split in (1, 7, 64, 1000, 1 << 20):
        reader, got = CommitLogReader({"uri": f"file://{os.path.realpath(tmp_dir)}", "range": split}), {}
        for part in reader.partitions():
            for batch in reader.read(part):
                got.setdefault(part.repo, []).extend(batch.column("path").to_pylist())
        assert {k: sorted(v) for k, v in got.items()} == want, split
    assert sorted(r.repo for r in history_repos(spark, tmp_dir).collect()) == sorted([*want, "none"])


def test_filters_reach_the_logs(spark, tmp_dir):
    import os
    from pyspark.sql import functions as F
    from faultline.sources import history_log as H
    for repo in ("one", "two"):
        with open(os.path.join(tmp_dir, f"{repo}.log"), "w") as f:
            f.write("src/a.ts\nlib/b.ts\nsrc/c.js\n")
    df = H.read_commit_log(spark, tmp_dir, apply_filter=False).filter((F.col("repo") == "two") & F.col("path").startswith("src/") & (F.length("path") > 3))
    assert sorted((r.repo, r.path) for r in df.collect()) == [("two", "src/a.ts"), ("two", "src/c.js")]
    reader = H.CommitLogReader({"uri": f"file://{os.path.realpath(tmp_dir)}"})
    left = list(reader.pushFilters([H.EqualTo(("repo",), "two"), H.StringStartsWith(("path",), "src/"), H.StringEndsWith(("repo",), "o")]))
    assert len(left) == 1 and [p.repo for p in reader.partitions()] == ["two"]
    assert [b.column("path").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["src/a.ts", "src/c.js"]]
