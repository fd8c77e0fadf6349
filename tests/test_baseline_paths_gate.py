"""Baseline (S3, S4, J3, P11, P12), path functions (P8-P10), gate
and the streaming gate (ST1)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from faultline.functions import display, paths
from faultline.operators import baseline as BL, gate as G
from faultline.sources import baseline_store as BS
from faultline.streaming.gate_stream import read_gate_verdicts, start_gate_stream, start_gate_verdict_stream


def metrics_df(spark, rows):
    return spark.createDataFrame(
        rows, "repo string, path string, lines int, complexity int, fan_in long, "
              "exported_symbols array<string>, touch_count long")


def test_delta_cases_and_relative_keys(spark, tmp_dir):
    root = "/home/u/repo"
    before = metrics_df(spark, [("r", root + "/lib/mill.ts", 12, 4, 0, ["g"], None),
                                ("r", root + "/lib/press.ts", 10, 2, 1, ["s"], None),
                                ("r", root + "/lib/a/b/gear.ts", 3, 1, 0, [], None),
                                ("r", root + "/lib/old.ts", 3, 1, 0, [], None)])
    rows = BL.baseline_rows(before.withColumn("root", F.lit(root)), "2026-01-02 03:04:05",
                            "0.1.0", root="root")
    keys = sorted(r.rel_path for r in rows.collect())
    assert "lib/a/b/gear.ts" in keys and not any(root in k for k in keys)
    path = os.path.join(tmp_dir, "baseline")
    BS.save_baseline(rows, path)
    assert BS.baseline_exists(spark, path)
    with pytest.raises(BS.BaselineExistsError):
        BS.save_baseline(rows, path)
    BS.save_baseline(rows, path, force=True)
    base = BS.load_baseline(spark, path)
    after = metrics_df(spark, [("r", root + "/lib/mill.ts", 31, 3, 0, ["g"], None),
                               ("r", root + "/lib/press.ts", 10, 2, 1, ["s"], None),
                               ("r", root + "/lib/fresh.ts", 1, 1, 0, [], None),
                               ("q", "/q/x.ts", 1, 1, 0, [], None)])
    cur = after.withColumn("rel_path", paths.relative_key("path", F.lit(root)))
    got = {r.rel_path: r for r in BL.delta_vs_baseline(cur, base).collect()}
    g = got["lib/mill.ts"]
    assert (g.complexity_delta, g.lines_delta, g.is_new, g.delta_text) == (-1, 19, False, "Δcomplexity=-1 Δlines=+19")
    s = got["lib/press.ts"]
    assert (s.complexity_delta, s.lines_delta, s.is_new, s.delta_text) == (0, 0, False, "Δcomplexity=±0 Δlines=±0")
    n = got["lib/fresh.ts"]
    assert n.is_new and n.delta_text == "NEW" and n.lines_delta == 0
    assert got["/q/x.ts"].delta_text == "" and not got["/q/x.ts"].has_baseline   # no baseline at all
    assert "lib/old.ts" not in got and len(got) == 4                           # deletions not reported


def test_corrupt_document_ignored(spark, tmp_dir):
    d = os.path.join(tmp_dir, "docs")
    os.makedirs(d)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write('{"files": [1,')
    doc = {"repo": "r", "createdAt": "2026-01-02T03:04:05.000Z", "toolVersion": "0.1.0",
           "files": {"src/a.ts": {"lines": 5, "cyclomaticComplexity": 2, "fanIn": 1,
                                  "exportCount": 1, "touchCount": None}}}
    with open(os.path.join(d, "good.json"), "w") as f:
        json.dump(doc, f, indent=2)
    rows = BS.load_baseline_documents(spark, d).collect()
    assert [(r.repo, r.rel_path, r.complexity) for r in rows] == [("r", "src/a.ts", 2)]
    assert BS.load_baseline_documents(spark, os.path.join(tmp_dir, "none")) is None
    assert [r.file.rsplit("/", 1)[1] for r in BS.corrupt_documents(spark, d).collect()] == ["bad.json"]


def test_documents_without_a_repo_member(spark, tmp_dir):
    doc = {"createdAt": "2026-01-02T03:04:05.000Z", "toolVersion": "0.1.0",
           "files": {"a.ts": {"lines": 5, "cyclomaticComplexity": 2, "fanIn": 1, "exportCount": 1, "touchCount": 3}}}
    for name in ("alpha.json", "repo=beta/baseline.json"):
        at = os.path.join(tmp_dir, "docs", name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            json.dump(doc, f)
    assert [r.repo for r in BS.load_baseline_documents(spark, os.path.join(tmp_dir, "docs", "alpha.json")).collect()] == ["alpha"]
    assert [r.repo for r in BS.load_baseline_documents(spark, os.path.join(tmp_dir, "docs", "repo=beta", "baseline.json")).collect()] == ["beta"]
    assert [r.repo for r in BS.load_baseline_documents(spark, os.path.join(tmp_dir, "docs", "alpha.json"), repo="given").collect()] == ["given"]


def test_broken_baseline_lines_are_absent(spark, tmp_dir):
    rows = metrics_df(spark, [("r", "a.ts", 5, 2, 0, [], None), ("r", "b.ts", 6, 2, 0, [], None)]).withColumn("rel_path", F.col("path"))
    at = os.path.join(tmp_dir, "baseline")
    BS.save_baseline(BL.baseline_rows(rows, "2026-01-02 03:04:05", "0.1.0"), at, fmt="json")
    with open(os.path.join(at, "repo=r", "extra.json"), "w") as f:
        f.write('{"rel_path": "c.ts", "lin\n{"lines": 3}\n')
    assert sorted(r.rel_path for r in BS.load_baseline(spark, at, "json").collect()) == ["a.ts", "b.ts"]


def test_baseline_keys_must_be_relative(spark):
    with pytest.raises(ValueError, match="relative"):
        BL.baseline_rows(metrics_df(spark, [("r", "/x/a.ts", 5, 2, 0, [], None)]), "2026-01-02 03:04:05", "0.1.0")


def test_path_functions(spark):
    df = spark.createDataFrame([("/e/Depot/Tools/lathe",), ("/z/mill",), ("E:/Depot/Tools/lathe",), ("/srv/mill/press",),
                                ("a\\b/c/d.ts",), ("x.ts",)], "p string")
    got = [r.d for r in df.select(paths.drive_path("p").alias("d")).collect()]
    assert got[:4] == ["E:/Depot/Tools/lathe", "Z:/mill", "E:/Depot/Tools/lathe", "/srv/mill/press"]
    sp = [r.s for r in df.select(paths.short_path("p").alias("s")).collect()]
    assert sp[4] == "b/c/d.ts" and sp[5] == "x.ts"
    keys = spark.createDataFrame([("E:/Depot/TOOLS/gear.ts", True), ("E:\\depot\\tools\\Gear.ts", True),
                                  ("/Srv/Mill", False)], "p string, ci boolean")
    k = [r.k for r in keys.select(paths.path_key("p", F.col("ci")).alias("k")).collect()]
    assert k[0] == k[1] and k[2] == "/Srv/Mill"
    rk = spark.createDataFrame([("/repo/src/a.ts",), ("/repo2/x.ts",), ("/elsewhere/y.ts",)], "p string")
    assert [r.k for r in rk.select(paths.relative_key("p", F.lit("/repo")).alias("k")).collect()] == \
        ["src/a.ts", "/repo2/x.ts", "/elsewhere/y.ts"]
    lab = spark.createDataFrame([(0,), (3,), (-2,)], "d int")
    assert [r.l for r in lab.select(display.delta_label("d").alias("l")).collect()] == ["±0", "+3", "-2"]


def big_source(n_ifs=8, n_lines=90):
    body = "\n".join(f"  if (x > {i}) {{ y++; }}" for i in range(n_ifs))
    pad = "\n" * (n_lines - n_ifs - 3)
    return f"export function f(x: number) {{\n  let y = 0;\n{body}{pad}\n}}"


def test_gate_batch(spark):
    changes = spark.createDataFrame(
        [("r", "c1", "A", "src/big.ts", big_source()), ("r", "c1", "M", "src/small.ts", "export const a = 1;"),
         ("r", "c1", "D", "src/gone.ts", big_source()), ("r", "c1", "M", "README.md", big_source()),
         ("r", "c2", "C", "src/big2.tsx", big_source())],
        "repo string, commit_id string, status string, path string, content string")
    files = G.changed_files(changes)
    assert sorted(r.path for r in files.collect()) == ["src/big.ts", "src/big2.tsx", "src/small.ts"]
    from faultline.operators.metrics import file_metrics
    st = G.gate_status(file_metrics(files, keys=("repo", "commit_id")), strict=F.col("commit_id") == "c2")
    got = {r.path: r for r in st.collect()}
    assert got["src/big.ts"].status == "WARN" and got["src/big.ts"].message.startswith("WARN  src/big.ts  (lines=")
    assert got["src/small.ts"].status == "OK" and got["src/big2.tsx"].status == "FAIL"
    v = {r.commit_id: r.failed for r in G.gate_verdict(st, keys=("commit_id",)).collect()}
    assert v == {"c1": False, "c2": True}


def test_gate_stream_available_now(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    changes = spark.createDataFrame(
        [("r", "c1", "A", "src/big.ts", big_source()), ("r", "c1", "D", "src/x.ts", "")],
        "repo string, commit_id string, status string, path string, content string")
    changes.write.parquet(src)
    q = start_gate_stream(spark, src, out, name=f"t{os.getpid()}-{os.path.basename(tmp_dir)}",
                          available_now=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert [(r.path, r.status) for r in rows] == [("src/big.ts", "WARN")]


def test_gate_verdict_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    out, ver = os.path.join(tmp_dir, "status"), os.path.join(tmp_dir, "verdict")
    spark.createDataFrame(
        [("r", "c1", "A", "src/big.ts", big_source()), ("r", "c2", "M", "src/ok.ts", "export const a = 1;")],
        "repo string, commit_id string, status string, path string, content string").write.parquet(src)
    q = start_gate_verdict_stream(spark, src, out, ver, name=f"v{os.getpid()}-{os.path.basename(tmp_dir)}",
                                  available_now=True, strict=True)
    q.awaitTermination(120)
    v = {r.commit_id: (r.n_flagged, r.failed) for r in spark.read.parquet(ver).collect()}
    assert v == {"c1": (1, True), "c2": (0, False)}
    assert spark.read.parquet(out).count() == 2


def test_verdicts_merge_over_batches(spark, tmp_dir):
    src, ver = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "verdict")
    assert read_gate_verdicts(spark, ver).count() == 0
    rows = [("r", "c1", "A", "src/big.ts", big_source()), ("r", "c1", "M", "src/ok.ts", "export const a = 1;"), ("r", "c2", "M", "src/ok.ts", "")]
    for row in rows:
        spark.createDataFrame([row], "repo string, commit_id string, status string, path string, content string").write.mode("append").parquet(src)
    q = start_gate_verdict_stream(spark, src, os.path.join(tmp_dir, "status"), ver, name=f"m{os.getpid()}-{os.path.basename(tmp_dir)}",
                                  available_now=True, strict=True, max_files_per_trigger=1)
    q.awaitTermination(120)
    assert spark.read.parquet(ver).count() == 3
    got = {r.commit_id: (r.n_checked, r.n_flagged, r.failed) for r in read_gate_verdicts(spark, ver).collect()}
    assert got == {"c1": (2, 1, True), "c2": (1, 0, False)}


def _baseline(spark, repos, version):
    return spark.createDataFrame([(r, f"{i}.ts", i, 1, 0, 0, None, None, version) for r in repos for i in range(3)],
                                 "repo string, rel_path string, lines int, complexity int, fan_in long, export_count int, touch_count long, created_at timestamp, tool_version string")


def test_one_of_two_writers_commits(spark, tmp_dir):
    import threading
    from faultline.sources import baseline_store as BS, baseline_versions as BV
    assert BV.read_baseline(spark, tmp_dir) is None
    done = []

    def write(name):
        try:
            BV.commit_baseline(_baseline(spark, ["a", "b"], name), tmp_dir)
            done.append(name)
        except BS.BaselineExistsError:
            pass

    threads = [threading.Thread(target=write, args=(str(i),)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1
    assert {r.tool_version for r in BV.read_baseline(spark, tmp_dir).collect()} == set(done)
    BV.commit_baseline(_baseline(spark, ["c"], "other"), tmp_dir)  # another repository has none yet
    BV.commit_baseline(_baseline(spark, ["b"], "forced"), tmp_dir, force=True)
    got = {(r.repo, r.tool_version) for r in BV.read_baseline(spark, tmp_dir).collect()}
    assert got == {("a", done[0]), ("b", "forced"), ("c", "other")}


def test_failed_forced_write_leaves_the_old_baseline(spark, tmp_dir, monkeypatch):
    import pytest
    from faultline.sources import baseline_versions as BV
    BV.commit_baseline(_baseline(spark, ["a"], "old"), tmp_dir)
    bad = _baseline(spark, ["a"], "new").selectExpr("* except (lines)", "IF(lines = 2, CAST(raise_error('lost') AS INT), lines) AS lines")
    with pytest.raises(Exception, match="lost"):
        BV.commit_baseline(bad, tmp_dir, force=True)
    monkeypatch.setattr(BV, "_create", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        BV.commit_baseline(_baseline(spark, ["a"], "new"), tmp_dir, force=True)
    assert {r.tool_version for r in BV.read_baseline(spark, tmp_dir).collect()} == {"old"}


def test_counts_at_many_dates(spark):
    import random
    from pyspark.sql import functions as F
    from faultline.operators.snapshots import cumulative_counts, deltas_over_dates
    rng = random.Random(9)
    rows = [("r", rng.choice("abc"), rng.choice([None, *range(6)]), rng.choice("xyz"), rng.choice([None, *range(1, 9)])) for _ in range(80)]
    events = spark.createDataFrame(rows, "repo string, path string, commit_id int, src_path string, committed_at int")
    files = spark.createDataFrame([("r", p) for p in "abcd"] + [("q", "a")], "repo string, path string")
    dates = spark.createDataFrame([("r", x) for x in (0, 1, 4, 9)], "repo string, committed_at int")
    found = deltas_over_dates(cumulative_counts(events, {"touches": "commit_id", "fan_in": "src_path"}), files, dates, ["touches", "fan_in"])
    for r in found.collect():
        own = [x for x in rows if x[1] == r.path and x[4] is not None]
        before = [x for x in own if x[4] < r.committed_at]
        touches = lambda xs: len({x[2] for x in xs if x[2] is not None})
        fan = lambda xs: len({x[3] for x in xs})
        assert (r.touches, r.fan_in, r.touches_delta, r.fan_in_delta) == (touches(before), fan(before), touches(own) - touches(before), fan(own) - fan(before))
        assert r.is_new == (not before)
    assert found.count() == 16


def test_commit_closes_once(spark, tmp_dir):
    import os
    from pyspark.sql import functions as F
    from faultline.streaming.gate_stream import start_commit_verdict_stream
    source, out = os.path.join(tmp_dir, "changes"), os.path.join(tmp_dir, "verdicts")
    big = "if (a) {}\n" * 100

    def deliver(rows):
        spark.createDataFrame([("r", c, s, p, t, x) for c, s, p, t, x in rows], "repo string, commit_id string, status string, path string, content string, at long").select(
            "repo", "commit_id", "status", "path", "content", F.timestamp_seconds("at").alias("staged_at")).coalesce(1).write.mode("append").parquet(source)
        start_commit_verdict_stream(spark, source, out, name=os.path.basename(tmp_dir), available_now=True, quiet="1 minute", late="10 minutes", strict=True).awaitTermination()
        return sorted((r.commit_id, r.n_checked, r.n_flagged, r.failed) for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    assert deliver([("c1", "A", "a.ts", big, 1000), ("c1", "M", "b.ts", "", 1000), ("c1", "D", "d.ts", big, 1000), ("c2", "A", "a.ts", "", 1030)]) == []
    assert deliver([("c1", "A", "a.ts", big, 1010), ("c1", "A", "c.ts", big, 1010)]) == []  # a.ts again
    first = [("c1", 3, 2, True), ("c2", 1, 0, False)]
    assert deliver([("c3", "A", "a.ts", big, 9000)]) == first
    assert deliver([("c4", "A", "a.ts", "", 20000)]) == first + [("c3", 1, 1, True)]


def test_gate_batch_parses_a_content_once(spark):
    from faultline.operators.metrics import file_metrics
    from faultline.streaming.gate_stream import gate_batch
    rows = [("r", f"c{i % 7}", "A", f"src/{i}.ts", big_source() if i % 2 else "export const a = 1;") for i in range(40)]
    rows += [rows[1], ("r", "c1", "M", "src/n.tsx", None), ("r", "c1", "D", "src/0.ts", "x")]
    changes = spark.createDataFrame(rows, "repo string, commit_id string, status string, path string, content string")
    got = gate_batch(changes)
    want = G.gate_status(file_metrics(G.changed_files(changes), keys=("repo", "commit_id")))
    columns = ["repo", "commit_id", "path", "lines", "complexity", "flagged", "status", "message"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    # the texts meet in a hash aggregate before they are cut into tokens
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_changes_of_one_path_are_dealt_out(spark, tmp_dir):
    from faultline.plans import catalog
    spark.range(20).selectExpr("id AS p_partkey", "'red blue' AS p_name", "'SMALL' AS p_type", "cast(id + 1 AS int) AS p_size").write.parquet(f"{tmp_dir}/part.parquet")
    spark.range(4000).selectExpr("id AS l_orderkey", "id % 20 AS l_partkey", "'A' AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus").write.parquet(
        f"{tmp_dir}/lineitem.parquet")
    changes = catalog._source_changes(spark, tmp_dir, by_path=True).groupBy("path", F.spark_partition_id().alias("file")).count()
    script = [r["count"] for r in changes.filter("path = 'C:/w/run.js'").collect()]
    assert sum(script) == 2000 and len(script) > 1


def test_commit_verdicts_parse_a_content_once(spark, tmp_dir):
    from faultline.operators import metric_store as MS
    from faultline.operators.metrics import file_metrics
    rows = [("r", f"c{i % 50}", f"src/{i}.{'tsx' if i % 3 else 'ts'}", [big_source(), "export const a = <b>x ? y</b>;", "", None][min(i % 9, 3)]) for i in range(900)]
    files = spark.createDataFrame(rows, "repo string, commit_id string, path string, content string").repartition(3)
    got = MS.measured_changes(files, keys=("repo", "commit_id"))
    want = file_metrics(files, keys=("repo", "commit_id")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # what is cut into tokens: a row per content, but for those that one task has often
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Generate inline") < plan.index("regexp_extract_all") < plan.index("MapInArrow")
    rows = files.select("content", F.lit(False).alias("markup"), F.array(F.struct("path")).alias("changes"))
    assert rows.repartition(2, "content").mapInArrow(MS.gathered, rows.schema).count() == 4


def test_gathered_contents():
    import pyarrow as pa
    from faultline.operators import metric_store as MS
    schema = pa.schema([("content", pa.string()), ("markup", pa.bool_()), ("changes", pa.list_(pa.struct([("path", pa.string()), ("n", pa.int64())])))])

    def batch(rows):
        return pa.RecordBatch.from_pylist([{"content": c, "markup": m, "changes": [{"path": p, "n": n} for p, n in x]} for c, m, x in rows], schema=schema)

    given = [batch([("a", False, [("1", 1)]), ("b", False, [("2", 2)]), ("a", True, [("3", None)]), (None, False, [(None, 4)])]), batch([]),
             batch([("", False, [("5", 5)]), ("a", False, [("6", 6), ("7", 7)]), (None, False, [("8", 8)]), ("a", False, [("1", 1)])]).slice(1)]

    def rows(batches):
        return [(r["content"], r["markup"], [(x["path"], x["n"]) for x in r["changes"]]) for b in batches for r in b.to_pylist()]

    together = sorted(rows(MS.gathered(iter(given))), key=str)
    assert together == sorted([("a", False, [("1", 1), ("6", 6), ("7", 7), ("1", 1)]), ("b", False, [("2", 2)]), ("a", True, [("3", None)]),
                               (None, False, [(None, 4), ("8", 8)])], key=str)
    # with less held at a time no change is lost
    each = [(c, m, x) for c, m, xs in rows(MS.gathered(iter(given), held=1)) for x in xs]
    assert sorted(each, key=str) == sorted([(c, m, x) for c, m, xs in together for x in xs], key=str)
    assert list(MS.gathered(iter([]))) == []


def test_changes_hold_a_text_made_once_for_its_part(spark, tmp_dir):
    from faultline.plans import catalog
    spark.range(20).selectExpr("id AS p_partkey", "'red blue' AS p_name", "'SMALL' AS p_type", "cast(id + 1 AS int) AS p_size").write.parquet(f"{tmp_dir}/part.parquet")
    spark.range(400).selectExpr("id AS l_orderkey", "id % 20 AS l_partkey", "'A' AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus").write.parquet(
        f"{tmp_dir}/lineitem.parquet")
    changes = catalog._source_changes(spark, tmp_dir)
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("repeat(")
    assert changes.count() == 400 and changes.select("content").distinct().count() == 20
