"""Source-tree scan (S1, F1), import resolution (J1) and fan-in (A1)."""

import os

import pytest

from faultline.operators.graph import fan_in, resolve_imports
from faultline.operators.metrics import scan
from faultline.sources.source_tree import read_source_forest, read_source_tree


def write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_missing_path_raises(spark, tmp_dir):
    with pytest.raises(FileNotFoundError, match="does not exist"):
        read_source_tree(spark, os.path.join(tmp_dir, "nope"))


def test_file_path_raises(spark, tmp_dir):
    write(tmp_dir, "f.txt", "not a directory")
    with pytest.raises(NotADirectoryError, match="not a directory"):
        read_source_tree(spark, os.path.join(tmp_dir, "f.txt"))


def test_empty_directory_gives_no_rows(spark, tmp_dir):
    assert read_source_tree(spark, tmp_dir).count() == 0


def test_ignore_rules(spark, tmp_dir):
    write(tmp_dir, "shape.test-d.ts", "type Shape = { kind: 'round' };")
    write(tmp_dir, "ledger.ts", "export const balance = (rows: number[]) => rows.length;")
    write(tmp_dir, "ledger.test.ts", "export const sample = [1, 2];")
    write(tmp_dir, "pages/_app.tsx", "export default function App() { return null; }")
    write(tmp_dir, "src/__tests__/sum.test.ts", "export const t = 1;")
    write(tmp_dir, ".storybook/main.ts", "export const stories = [];")
    write(tmp_dir, ".git/hooks/x.ts", "export const no = 1;")
    write(tmp_dir, "node_modules/dep/index.ts", "export const x = 1;")
    write(tmp_dir, "src/dist/out.ts", "export const y = 1;")
    write(tmp_dir, "src/lib.d.ts", "declare const z: number;")
    write(tmp_dir, "notes.md", "# not code")
    rows = read_source_tree(spark, tmp_dir, repo="r").select("rel_path").collect()
    assert sorted(r.rel_path for r in rows) == [
        ".storybook/main.ts", "ledger.test.ts", "ledger.ts", "pages/_app.tsx", "src/__tests__/sum.test.ts"]
    everything = read_source_tree(spark, tmp_dir, repo="r", exclude=[]).select("rel_path", "path", "content").collect()
    assert len(everything) == 10 and all(r.path.endswith("/" + r.rel_path) and r.content for r in everything)


def test_scan_resolves_imports_and_counts_fan_in(spark, tmp_dir):
    write(tmp_dir, "src/b.ts", 'import { b } from "./b";\nexport const b = 1;')
    write(tmp_dir, "src/a.ts", 'import { b } from "./b";\nimport { b as c } from "./b.js";\n'
                               'import { u } from "./util";\nexport const a = b;')
    write(tmp_dir, "src/util/index.ts", 'import { b } from "../b";\nexport const u = 1;')
    write(tmp_dir, "src/deep/c.tsx", 'import { a } from "../a";\nimport x from "react";\n'
                                     'export default function C() { return a; }')
    df = read_source_tree(spark, tmp_dir, repo="r")
    got = {r.rel_path: r.fan_in for r in scan(df).collect()}
    # b: imported by a (twice, deduped) and util; its self-import is dropped
    assert got == {"src/b.ts": 2, "src/a.ts": 1, "src/util/index.ts": 1, "src/deep/c.tsx": 0}


def test_fan_in_sum_equals_distinct_edges(spark):
    files = spark.createDataFrame([("r", "/x/a.ts", ["./b", "./c"]), ("r", "/x/b.ts", ["./c"]),
                                   ("r", "/x/c.ts", ["./c", "../y"])],
                                  "repo string, path string, imported_from array<string>")
    edges = resolve_imports(files)
    total = sum(r.fan_in for r in fan_in(files, edges).collect())
    assert total == edges.count() == 3


def test_directory_imports(spark):
    files = spark.createDataFrame(
        [("r", "index.ts", []), ("r", "a/index.tsx", ["..", "./"]), ("r", "a/b.ts", [".", "..", "./c.js", "./c"]),
         ("r", "a/c.ts", ["../a/", "../a", "../a.js"]), ("r", "a/c/index.ts", ["./"]), ("r", "a.d.ts", ["./a/b.ts", "./b"])],
        "repo string, path string, imported_from array<string>")
    got = sorted((r.src_path, r.dst_path) for r in resolve_imports(files).collect())
    # "../a" is the file a.d.ts before the directory a; "../a/" is the directory
    assert got == [("a.d.ts", "a/b.ts"), ("a/b.ts", "a/c.ts"), ("a/b.ts", "a/index.tsx"), ("a/b.ts", "index.ts"),
                   ("a/c.ts", "a.d.ts"), ("a/c.ts", "a/index.tsx"), ("a/index.tsx", "index.ts")]


def test_star_exports_followed_to_the_end(spark, tmp_dir):
    write(tmp_dir, "a.ts", 'export * from "./l1";\nexport const own = 1;')
    for i in range(1, 7):
        write(tmp_dir, f"l{i}.ts", f"export * from './l{i + 1}';\nexport default {i};")
    write(tmp_dir, "l7.ts", "export const deepest = 1;\nexport * as ns from './a';\nexport * from './l3';")
    got = {r.rel_path: r.exported_symbols for r in scan(read_source_tree(spark, tmp_dir, repo="r")).collect()}
    # `export * as ns` makes ns a named export of l7, so `export *` passes it on; l7 and l3 re-export each other
    assert got["a.ts"] == ["own", "deepest", "ns"]
    assert all(got[f"l{i}.ts"] == ["default", "deepest", "ns"] for i in range(1, 7))
    assert got["l7.ts"] == ["deepest", "ns"]


def test_sources_are_read_once(spark, tmp_dir):
    write(tmp_dir, "a.ts", 'export * from "./b";')
    write(tmp_dir, "b.ts", "export const b = 1;")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = read_source_tree(spark, tmp_dir, repo="r")
    rows = scan(df.mapInArrow(count, df.schema)).collect()
    assert len(rows) == 2 and reads.value == 2


def test_forest_reads_many_repos_at_once(spark, tmp_dir):
    write(tmp_dir, "one/src/a.ts", 'import { b } from "./b";\nexport const a = b;')
    write(tmp_dir, "one/src/b.ts", "export const b = 1;")
    write(tmp_dir, "one/node_modules/x/index.ts", "export const x = 1;")
    write(tmp_dir, "two/b.ts", "export const b = 2;")
    write(tmp_dir, "two/dist/b.ts", "export const b = 3;")
    write(tmp_dir, "stray.ts", "export const s = 1;")
    df = read_source_forest(spark, tmp_dir)
    got = sorted((r.repo, r.rel_path) for r in df.select("repo", "rel_path").collect())
    assert got == [("one", "src/a.ts"), ("one", "src/b.ts"), ("two", "b.ts")]
    fans = {(r.repo, r.path.rsplit("/", 1)[1]): r.fan_in for r in scan(df).collect()}
    assert fans == {("one", "a.ts"): 0, ("one", "b.ts"): 1, ("two", "b.ts"): 0}


def closure_of(spark, files, monkeypatch=None):
    """Names by file through star_closure, and the rounds it took."""
    from faultline.operators import metrics as M
    rows = [("r", p, own, [f"./{t}" for t in stars]) for p, own, stars in files]
    df = spark.createDataFrame(rows, "repo string, path string, exported_symbols array<string>, star_exports array<string>")
    tables = []
    if monkeypatch:
        plain = M.stored
        monkeypatch.setattr(M, "stored", lambda d, name: tables.append(name) or plain(d, name))
    got = {}
    for r in M.star_closure(df).collect():
        got.setdefault(r.path, set()).add(r.symbol)
    return got, tables.count("star-pairs")


def test_chain_of_forty_in_eight_rounds(spark, monkeypatch):
    files = [(f"f{i:02}.ts", [f"n{i}", "default"], [f"f{i + 1:02}"] if i < 39 else []) for i in range(40)]
    got, rounds = closure_of(spark, files, monkeypatch)
    assert got == {f"f{i:02}.ts": {f"n{j}" for j in range(i + 1, 40)} for i in range(39)}
    assert rounds <= 8


def test_closure_of_random_graphs(spark):
    import random
    rng = random.Random(2)
    for n, m in ((6, 9), (14, 16), (30, 34)):
        stars = {i: sorted({rng.randrange(n) for _ in range(m // n + (rng.random() < m / n % 1))} - {i}) for i in range(n)}
        got, _ = closure_of(spark, [(f"f{i}.ts", [f"n{i}"], [f"f{j}" for j in stars[i]]) for i in range(n)])
        for i in range(n):
            seen, todo = set(), list(stars[i])
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += stars[j]
            # a file in a cycle has its own names anyway
            assert got.get(f"f{i}.ts", set()) - {f"n{i}"} == {f"n{j}" for j in seen} - {f"n{i}"}


def test_one_join_resolves_imports_and_stars(spark, tmp_dir):
    from faultline.operators.metrics import file_metrics, scan_metrics
    from faultline.session import stored
    write(tmp_dir, "a.ts", 'import { b } from "./b";\nexport * from "./b";\nexport * from "./c";')
    write(tmp_dir, "b.ts", "export const b = 1;")
    write(tmp_dir, "c.ts", "export const c = 1;\nexport * from './a';")
    m = stored(file_metrics(read_source_tree(spark, tmp_dir, repo="r")), "file-metrics")
    got = {r.rel_path: (r.fan_in, sorted(r.exported_symbols)) for r in scan_metrics(m).collect()}
    assert got == {"a.ts": (0, ["b", "c"]), "b.ts": (1, ["b"]), "c.ts": (0, ["b", "c"])}


def test_second_snapshot_parses_only_what_changed(spark, tmp_dir, monkeypatch):
    from faultline.operators import metric_store as S
    sources = [("r", f"src/f{i}.ts", f"export const n{i % 50} = {i % 50};\nimport './f{i % 50 + 1}';", f"src/f{i}.ts") for i in range(100)]
    schema = "repo string, path string, content string, rel_path string"
    parsed, plain = [], S.file_metrics

    def counted(texts, **kw):
        parsed.append(texts.count())
        return plain(texts, **kw)

    monkeypatch.setattr(S, "file_metrics", counted)
    store = os.path.join(tmp_dir, "store")

    def snapshot(rows):
        return sorted(tuple(r) for r in scan(spark.createDataFrame(rows, schema), store=store).collect())

    first = snapshot(sources)
    changed = [(*s[:2], s[2] + "\nif (a) {}", s[3]) if i == 7 else s for i, s in enumerate(sources)]
    second = snapshot(changed + [("r", "src/g.tsx", sources[0][2], "src/g.tsx"), ("q", "none.ts", None, "none.ts")])
    assert parsed == [50, 3]  # one changed content, one that is now markup, one null
    monkeypatch.undo()
    assert first == sorted(tuple(r) for r in scan(spark.createDataFrame(sources, schema)).collect())
    changed += [("r", "src/g.tsx", sources[0][2], "src/g.tsx"), ("q", "none.ts", None, "none.ts")]
    assert repr(second) == repr(sorted(tuple(r) for r in scan(spark.createDataFrame(changed, schema)).collect()))
