"""Registered queries: each reads the driver's tables through the bindings in
``faultline.sources.bindings`` and runs the library's operators on the whole
tables. ``ORACLE`` holds an equivalent DuckDB SQL text for each query that SQL
can express; the column names match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions import display, prompt as _prompt, text as _tx
from faultline.operators import graph, history, scoring
from faultline.session import checkpoint_path, stored
from faultline.sources import bindings as B
from faultline.sources.driver_tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


# ---------------------------------------------------------------- shared parts

def module_metrics(spark: SparkSession, d: str,
                   no_history_suffix: str | None = B.NO_HISTORY_SUFFIX) -> DataFrame:
    """Parts as modules, with fan-in (first-line edges) and touch counts."""
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    files = graph.fan_in(B.part_files(part), B.first_line_edges(li), keys=())
    touches = history.touch_frequency(B.lineitem_commits(li, B.TOUCH_CUT), keys=())
    return history.attach_touches(
        files, touches, keys=(), history_repos=B.history_brands(part, no_history_suffix),
        history_keys=("repo",))


SQL_FILES = """
files AS (
  SELECT p_brand AS repo, p_partkey AS path,
         CAST(floor(p_retailprice) AS INTEGER) AS lines, p_size AS complexity,
         p_name, (p_type = 'PROMO' AND p_size >= 45) AS has_syntax_errors
  FROM part)"""

SQL_FIRST_LINE = """
imp AS (
  SELECT l_orderkey, l_partkey AS src FROM (
    SELECT l_orderkey, l_partkey, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn
    FROM lineitem) WHERE rn = 1),
fan AS (
  SELECT l.l_partkey AS path, count(DISTINCT i.src) AS fan_in
  FROM lineitem l JOIN imp i USING (l_orderkey)
  WHERE i.src <> l.l_partkey GROUP BY 1)"""

SQL_TOUCH = """
tch AS (
  SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS touches
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-04-01' GROUP BY 1)"""

SQL_MM = ("WITH " + ",".join([SQL_FILES, SQL_FIRST_LINE, SQL_TOUCH]) + """,
mm AS (
  SELECT f.*, COALESCE(fan.fan_in, 0) AS fan_in,
         CASE WHEN f.repo LIKE '%7' THEN NULL ELSE COALESCE(t.touches, 0) END AS touch_count
  FROM files f LEFT JOIN fan USING (path) LEFT JOIN tch t USING (path)),
scored AS (
  SELECT *, complexity * 2 + lines * 0.1::DOUBLE + fan_in * 3
            + COALESCE(touch_count * 2, 0) AS score FROM mm)
""")


def scored_modules(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_score(module_metrics(spark, d))


# ---------------------------------------------------------------- A1 / J1

@register("fan_in", "WITH " + SQL_FILES + """
SELECT f.repo, f.path, COALESCE(c.fan_in, 0) AS fan_in
FROM files f LEFT JOIN (
  SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS fan_in
  FROM lineitem GROUP BY 1) c USING (path)
""")
def q_fan_in(spark, d):
    files = B.part_files(table(spark, d, "part"))
    edges = B.order_part_edges(table(spark, d, "lineitem"))
    return graph.fan_in(files, edges, keys=(), drop_self=False).select("repo", "path", "fan_in")


@register("fan_in_no_self", "WITH " + SQL_FILES + "," + SQL_FIRST_LINE + """
SELECT f.repo, f.path, COALESCE(fan.fan_in, 0) AS fan_in
FROM files f LEFT JOIN fan USING (path)
""")
def q_fan_in_no_self(spark, d):
    files = B.part_files(table(spark, d, "part"))
    edges = B.first_line_edges(table(spark, d, "lineitem"))
    return graph.fan_in(files, edges, keys=()).select("repo", "path", "fan_in")


# ---------------------------------------------------------------- A2 / J2

@register("touch_frequency", """
SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS touches
FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-04-01' GROUP BY 1
""")
def q_touch_frequency(spark, d):
    commits = B.lineitem_commits(table(spark, d, "lineitem"), B.TOUCH_CUT)
    return history.touch_frequency(commits, keys=())


@register("touch_attach", "WITH " + SQL_FILES + "," + SQL_TOUCH + """
SELECT f.repo, f.path, COALESCE(t.touches, 0) AS touch_count
FROM files f LEFT JOIN tch t USING (path)
""")
def q_touch_attach(spark, d):
    part = table(spark, d, "part")
    touches = history.touch_frequency(
        B.lineitem_commits(table(spark, d, "lineitem"), B.TOUCH_CUT), keys=())
    return history.attach_touches(B.part_files(part), touches, keys=(),
                                  has_history=True).select("repo", "path", "touch_count")


@register("touch_no_history", "WITH " + SQL_FILES + "," + SQL_TOUCH + """
SELECT f.repo, f.path,
       CASE WHEN f.repo LIKE '%7' THEN NULL ELSE COALESCE(t.touches, 0) END AS touch_count
FROM files f LEFT JOIN tch t USING (path)
""")
def q_touch_no_history(spark, d):
    part = table(spark, d, "part")
    touches = history.touch_frequency(
        B.lineitem_commits(table(spark, d, "lineitem"), B.TOUCH_CUT), keys=())
    return history.attach_touches(
        B.part_files(part), touches, keys=(), history_repos=B.history_brands(part),
        history_keys=("repo",)).select("repo", "path", "touch_count")


@register("any_touch", SQL_MM + """
SELECT repo, bool_or(touch_count IS NOT NULL) AS has_touch_data FROM mm GROUP BY repo
""")
def q_any_touch(spark, d):
    return history.any_touch(module_metrics(spark, d))


# ---------------------------------------------------------------- P6 / P7 / T1 / T2

@register("outlier_score", SQL_MM + """
SELECT repo, path, complexity, lines, fan_in, touch_count, score,
       CAST(round(score) AS INTEGER) AS display_score
FROM scored
""")
def q_outlier_score(spark, d):
    s = scored_modules(spark, d)
    return s.select("repo", "path", "complexity", "lines", "fan_in", "touch_count",
                    "score", display.display_score("score").alias("display_score"))


TOPK = 25
TOPK_PER_REPO = 5


@register("outlier_topk", SQL_MM + f"""
SELECT repo, path, score, row_number() OVER (ORDER BY score DESC, path) AS rank
FROM scored ORDER BY score DESC, path LIMIT {TOPK}
""")
def q_outlier_topk(spark, d):
    s = scored_modules(spark, d).select("repo", "path", "score")
    return scoring.top_k(s, TOPK)


@register("outlier_topk_per_repo", SQL_MM + f"""
SELECT * FROM (
  SELECT repo, path, score,
         row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank
  FROM scored) WHERE rank <= {TOPK_PER_REPO}
""")
def q_outlier_topk_per_repo(spark, d):
    s = scored_modules(spark, d).select("repo", "path", "score")
    return scoring.top_k_per_group(s, TOPK_PER_REPO, keys=("repo",))


# ---------------------------------------------------------------- J3 / P12 (baseline)

def module_snapshots(spark: SparkSession, d: str):
    """(current module metrics, baseline rows as of ``B.BASELINE_CUT``). Both come
    from one stored row per part, so lineitem is read twice for all of it."""
    from faultline.operators.baseline import baseline_rows
    part = table(spark, d, "part")
    states = stored(B.part_files(part).join(B.part_states(table(spark, d, "lineitem")), "path", "left"), "part-states")

    def as_of(name):
        rows = states.withColumn("fan_in", F.coalesce(f"fan_in_{name}", F.lit(0).cast("long")))
        touches = states.select("path", F.coalesce(f"touches_{name}", F.lit(0).cast("long")).alias("touches"))
        return rows.drop(*B_STATES), touches

    files, touches = as_of("now")
    current = history.attach_touches(files, touches, keys=(), history_repos=B.history_brands(part), history_keys=("repo",))
    old, touches = as_of("then")
    seen = states.filter(F.col("first_seen") < B.cut(B.BASELINE_CUT)).select("path")
    base = history.attach_touches(old.join(seen, "path", "left_semi"), touches, keys=())
    # Sizes then differ from now, by the part's key.
    base = base.withColumn("lines", (F.col("lines") - F.col("path") % 4 + 1).cast("int")).withColumn(
        "complexity", (F.col("complexity") - F.col("path") % 3 + 1).cast("int"))
    return current, baseline_rows(base.withColumn("rel_path", F.col("path")), B.BASELINE_CUT, "0.1.0", keys=("repo",))


B_STATES = ("fan_in_now", "fan_in_then", "touches_now", "touches_then", "first_seen")


def baseline_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Module metrics as they stood before the cut: a part exists once a
    lineitem ships, fan-in counts first-line edges before the cut."""
    return module_snapshots(spark, d)[1]


SQL_BASE = """,
imp_b AS (
  SELECT l_orderkey, l_partkey AS src FROM (
    SELECT l_orderkey, l_partkey, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn
    FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01') WHERE rn = 1),
fan_b AS (
  SELECT l.l_partkey AS path, count(DISTINCT i.src) AS fan_in
  FROM lineitem l JOIN imp_b i USING (l_orderkey)
  WHERE i.src <> l.l_partkey AND l.l_shipdate < TIMESTAMP '1995-02-01' GROUP BY 1),
base AS (
  SELECT f.repo, f.path, CAST(f.lines - f.path % 4 + 1 AS INTEGER) AS lines,
         CAST(f.complexity - f.path % 3 + 1 AS INTEGER) AS complexity, COALESCE(fan_b.fan_in, 0) AS fan_in
  FROM files f LEFT JOIN fan_b USING (path)
  WHERE f.path IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'))
"""

SQL_DELTA = """,
dl AS (
  SELECT s.repo, s.path, b.path IS NULL AS is_new,
         CASE WHEN b.path IS NULL THEN 0 ELSE s.lines - b.lines END AS lines_delta,
         CASE WHEN b.path IS NULL THEN 0 ELSE s.complexity - b.complexity END AS complexity_delta,
         CASE WHEN b.path IS NULL THEN 0 ELSE s.fan_in - b.fan_in END AS fan_in_delta
  FROM scored s LEFT JOIN base b ON s.repo = b.repo AND s.path = b.path)
"""


def _sql_label(x: str) -> str:
    return (f"CASE WHEN {x} = 0 THEN '±0' WHEN {x} > 0 THEN '+' || CAST({x} AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


@register("baseline_delta", SQL_MM + SQL_BASE + SQL_DELTA + f"""
SELECT repo, path, lines_delta, complexity_delta, fan_in_delta, is_new,
       CASE WHEN is_new THEN 'NEW' ELSE 'Δcomplexity=' || {_sql_label('complexity_delta')}
            || ' Δlines=' || {_sql_label('lines_delta')} END AS delta_text
FROM dl
""")
def q_baseline_delta(spark, d):
    from faultline.operators.baseline import delta_vs_baseline
    current, base = module_snapshots(spark, d)
    cur = current.withColumnRenamed("path", "rel_path")
    out = delta_vs_baseline(cur, base, keys=("repo",))
    return out.select("repo", F.col("rel_path").alias("path"), "lines_delta",
                      "complexity_delta", "fan_in_delta", "is_new", "delta_text")


@register("baseline_snapshot", "WITH " + SQL_FILES + SQL_BASE + """,
tb AS (
  SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS touches
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01' GROUP BY 1)
SELECT b.repo, b.path AS rel_path, b.lines, b.complexity, b.fan_in,
       CAST(len(string_split(f.p_name, ' ')) AS INTEGER) AS export_count,
       COALESCE(tb.touches, 0) AS touch_count
FROM base b JOIN files f USING (path) LEFT JOIN tb USING (path)
""")
def q_baseline_snapshot(spark, d):
    return baseline_snapshot(spark, d).drop("created_at", "tool_version")


# ---------------------------------------------------------------- F3 / T3 / F4

DRIFT_K, DRIFT_MIN_LINES, DRIFT_MIN_COMPLEXITY = 25, 950, 8


@register("drift_candidates", SQL_MM + f"""
, ranked AS (
  SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rk
  FROM scored WHERE NOT has_syntax_errors)
SELECT s.repo, s.path, CASE WHEN r.rk <= {DRIFT_K} THEN r.rk END AS rank,
       CASE WHEN s.has_syntax_errors THEN 'broken'
            WHEN r.rk IS NULL OR r.rk > {DRIFT_K} THEN 'beyond_top'
            WHEN s.lines >= {DRIFT_MIN_LINES} AND s.complexity >= {DRIFT_MIN_COMPLEXITY}
              THEN 'candidate'
            ELSE 'skipped_small' END AS status
FROM scored s LEFT JOIN ranked r USING (path)
""")
def q_drift_candidates(spark, d):
    from faultline.operators.candidates import classify_all, drift_candidates
    s = scored_modules(spark, d)
    top = drift_candidates(s, DRIFT_K, DRIFT_MIN_LINES, DRIFT_MIN_COMPLEXITY)
    return classify_all(s, top, keys=(), path="path").select(
        "repo", "path", F.col("rank").cast("long").alias("rank"), "status")


# ---------------------------------------------------------------- F5 / F6 / F7

GATE_STRICT_SUFFIX = "3"   # repositories ending in this digit run the gate strictly


def _gated(spark, d):
    from faultline.operators.gate import gate_status
    files = B.part_files(table(spark, d, "part"))
    return gate_status(files, DRIFT_MIN_LINES, DRIFT_MIN_COMPLEXITY,
                       strict=F.col("repo").endswith(GATE_STRICT_SUFFIX))


SQL_GATED = "WITH " + SQL_FILES + f""",
gated AS (
  SELECT *, lines >= {DRIFT_MIN_LINES} AND complexity >= {DRIFT_MIN_COMPLEXITY} AS flagged,
         repo LIKE '%{GATE_STRICT_SUFFIX}' AS strict FROM files),
st AS (
  SELECT *, CASE WHEN flagged THEN (CASE WHEN strict THEN 'FAIL' ELSE 'WARN' END)
                 ELSE 'OK' END AS status FROM gated)
"""


@register("gate_status", SQL_GATED + """
SELECT repo, path, flagged, status,
       status || '  ' || CAST(path AS VARCHAR) || '  (lines=' || CAST(lines AS VARCHAR)
       || ', complexity=' || CAST(complexity AS VARCHAR) || ')'
       || CASE WHEN flagged THEN ' — big/complex enough to warrant a look.' ELSE '' END AS message
FROM st
""")
def q_gate_status(spark, d):
    return _gated(spark, d).select("repo", "path", "flagged", "status", "message")


@register("gate_verdict", SQL_GATED + """
SELECT repo, count(*) AS n_checked, count(*) FILTER (WHERE flagged) AS n_flagged,
       COALESCE(bool_or(flagged AND strict), false) AS failed
FROM st GROUP BY repo
""")
def q_gate_verdict(spark, d):
    from faultline.operators.gate import gate_verdict
    return gate_verdict(_gated(spark, d), keys=("repo",))


@register("changed_files", """
SELECT l_orderkey AS commit_id, l_returnflag AS status,
       'src/' || CAST(l_partkey AS VARCHAR) || CASE l_linestatus WHEN 'O' THEN '.ts' ELSE '.js' END
         AS path
FROM lineitem
WHERE l_returnflag IN ('A', 'C', 'M')
  AND regexp_matches('src/' || CAST(l_partkey AS VARCHAR)
        || CASE l_linestatus WHEN 'O' THEN '.ts' ELSE '.js' END, '\\.(ts|tsx)$')
""")
def q_changed_files(spark, d):
    from faultline.operators.gate import changed_files
    return changed_files(B.lineitem_changes(table(spark, d, "lineitem"))).select(
        "commit_id", "status", "path")


# ---------------------------------------------------------------- F1 / P8-P11 on URLs

URL_INCLUDE = [r"/(en|fr)/"]
URL_EXCLUDE = [r"[?#]", r"\.html$"]


@register("path_filters", r"""
SELECT page_id, url FROM pages
WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '[?#]')
  AND NOT regexp_matches(url, '\.html$')
""")
def q_path_filters(spark, d):
    from faultline.operators.filters import path_rules
    pages = table(spark, d, "pages").select("page_id", "url")
    return path_rules(pages, "url", URL_INCLUDE, URL_EXCLUDE)


@register("short_path", r"""
SELECT page_id,
  array_to_string(list_slice(string_split_regex(url, '[\\/]'),
    greatest(len(string_split_regex(url, '[\\/]')) - 2, 1),
    len(string_split_regex(url, '[\\/]'))), '/') AS short_path,
  string_split_regex(url, '[\\/]')[-1] AS base_name
FROM pages
""")
def q_short_path(spark, d):
    from faultline.functions.paths import base_name, short_path
    return table(spark, d, "pages").select(
        "page_id", short_path("url").alias("short_path"), base_name("url").alias("base_name"))


# A path per page: with a drive prefix, with capitals and backslashes, or plain;
# ``chr(92)`` is the backslash in both engines.
PAGE_PATH_SQL = """CASE page_id % 4
  WHEN 0 THEN '/' || chr(CAST(97 + page_id % 26 AS INTEGER)) || '/Work/Site' || CAST(page_id AS VARCHAR(20)) || '/A.ts'
  WHEN 1 THEN 'D:' || chr(92) || 'Work' || chr(92) || 'Site' || CAST(page_id AS VARCHAR(20)) || chr(92) || 'b.ts'
  WHEN 2 THEN '/home/Dev/Site/' || CAST(page_id AS VARCHAR(20)) || '.ts'
  ELSE '/cc/x' || CAST(page_id AS VARCHAR(20)) END"""


@register("path_keys", f"""
WITH p AS (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages)
SELECT page_id,
  CASE WHEN page_id % 4 = 2 THEN CAST(page_id AS VARCHAR) || '.ts' ELSE replace(path, chr(92), '/') END AS rel_key,
  CASE WHEN page_id % 4 = 0 THEN upper(substr(path, 2, 1)) || ':' || substr(path, 3) ELSE path END AS drive_path,
  CASE WHEN page_id % 3 = 0 THEN lower(replace(path, chr(92), '/')) ELSE replace(path, chr(92), '/') END AS match_key
FROM p
""")
def q_path_keys(spark, d):
    from faultline.functions.paths import drive_path, path_key, relative_key
    path = F.expr(PAGE_PATH_SQL)
    return table(spark, d, "pages").select("page_id", path.alias("path")).select(
        "page_id", relative_key("path", F.lit("/home/Dev/Site/")).alias("rel_key"),
        drive_path("path").alias("drive_path"), path_key("path", F.col("page_id") % 3 == 0).alias("match_key"))


# A file per part, in and beside the directories and suffixes that the default rules know.
RULED_PATH_SQL = """CASE p_size % 9
  WHEN 0 THEN 'src/dist/m.ts' WHEN 1 THEN 'node_modules/a/m.tsx' WHEN 2 THEN 'a/m.d.ts' WHEN 3 THEN 'm.test-d.ts'
  WHEN 4 THEN 'src/m.test.ts' WHEN 5 THEN 'pages/_app.tsx' WHEN 6 THEN 'builder/m.ts' WHEN 7 THEN 'coverage.ts' ELSE 'src/m.js' END"""


@register("path_rules_default", f"""
SELECT p_partkey, {RULED_PATH_SQL} AS rel_path FROM part WHERE p_size % 9 IN (4, 5, 6, 7)
""")
def q_path_rules_default(spark, d):
    from faultline.operators.filters import path_rules
    return path_rules(table(spark, d, "part").select("p_partkey", F.expr(RULED_PATH_SQL).alias("rel_path")))


HISTORY_LINE_SQL = """CASE l_linenumber % 5
  WHEN 0 THEN '  src/m' || CAST(l_partkey AS VARCHAR(20)) || '.ts ' WHEN 1 THEN 'web/node_modules/x/m.ts' WHEN 2 THEN 'src/m.js'
  WHEN 3 THEN '   ' ELSE 'src/v' || CAST(l_partkey AS VARCHAR(20)) || '.tsx' END"""


@register("history_filter", f"""
SELECT l_orderkey AS commit_id, trim({HISTORY_LINE_SQL}) AS path FROM lineitem WHERE l_linenumber % 5 IN (0, 4)
""")
def q_history_filter(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.expr(HISTORY_LINE_SQL).alias("path"))
    return history.history_path_filter(lines)


# ---------------------------------------------------------------- X1-X8, A6, A7 (answers)

def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fmt(msg: str, *exprs: str) -> str:
    """SQL text for a %s/%d message with SQL expressions in the slots."""
    import re as _re
    parts = _re.split(r"%[sd]", msg)
    out = sql_lit(parts[0])
    for e, p in zip(exprs, parts[1:]):
        out += f" || CAST(({e}) AS VARCHAR) || " + sql_lit(p)
    return out


# One model answer per part, written as JSON text by string concatenation; the
# same SQL text builds it in Spark and in the oracle. Part types pick the shape
# of the split: none, empty, two entries sharing a symbol, one entry with an
# imported and a local symbol, a string instead of an array, an entry without
# movedExports. Small sizes get a ```json fence (size <= 3), trailing text (size
# 4), a second object (size 5), a repeated key (size 6), a leading no-break space
# (size 7) or one string for the list (size 8); sizes >= 45 omit driftSummary.
RAW_ANSWER_SQL = """
CASE WHEN p_size <= 3 THEN '```json' || chr(10) WHEN p_size = 7 THEN chr(160) ELSE '' END
|| '{"inferredOriginalPurpose": "' || p_type || '", "currentResponsibilities": '
|| CASE WHEN p_size = 8 THEN '"' || p_name || '"' ELSE '["' || replace(p_name, ' ', '", "') || '"]' END || ', "hasDrifted": '
|| CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END
|| CASE WHEN p_size >= 45 THEN '' ELSE ', "driftSummary": "' || p_name || '"' END
|| ', "suggestedSplit": ' || CASE p_type
  WHEN 'ECONOMY' THEN 'null'
  WHEN 'SMALL' THEN '[]'
  WHEN 'LARGE' THEN '[{"newFileName": "' || split_part(p_name, ' ', 1)
    || '.ts", "responsibility": "' || p_type || '", "movedExports": ["'
    || split_part(p_name, ' ', 1) || '", "' || split_part(p_name, ' ', 2)
    || '"]}, {"newFileName": "' || split_part(p_name, ' ', 2) || '.ts", "responsibility": "'
    || p_brand || '", "movedExports": ["' || split_part(p_name, ' ', 2) || '", "' || p_brand
    || '"]}]'
  WHEN 'MEDIUM' THEN '[{"newFileName": "core.ts", "responsibility": "core", "movedExports": ["'
    || split_part(p_name, ' ', 1) || '", "' || p_type || '", "helper"]}]'
  WHEN 'PROMO' THEN '"none"'
  ELSE '[{"newFileName": "' || split_part(p_name, ' ', 1) || '.ts", "responsibility": "misc"}]'
END || CASE WHEN p_size = 6 THEN ', "hasDrifted": true}' ELSE '}' END
|| CASE WHEN p_size <= 3 THEN chr(10) || '```' WHEN p_size = 4 THEN ' trailing' WHEN p_size = 5 THEN ' {"hasDrifted": true}' ELSE '' END
"""


def part_answers(spark: SparkSession, d: str) -> DataFrame:
    """``repo, path, raw_text, exported_symbols, imported_symbol_names`` for
    part answers plus conversation turns (prose, so error rows)."""
    # A count of its own keeps adaptive execution from making one task of narrow rows with much work.
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(wide, "p_partkey")
    pa = part.select(
        F.col("p_brand").alias("repo"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"),
        F.expr(RAW_ANSWER_SQL).alias("raw_text"),
        F.split("p_name", " ").alias("exported_symbols"),
        F.array("p_brand", "p_type").alias("imported_symbol_names"))
    conv = table(spark, d, "conversations").select(
        F.lit("conversations").alias("repo"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("path"),
        F.col("text").alias("raw_text"),
        F.array().cast("array<string>").alias("exported_symbols"),
        F.array().cast("array<string>").alias("imported_symbol_names"))
    return pa.unionByName(conv)


def validated(spark, d):
    from faultline.operators.validation import validate_answers
    return validate_answers(part_answers(spark, d))


def _sql_validation() -> str:
    from faultline.operators import validation as V
    w1, w2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    contra, noplan = sql_lit(V.MSG_CONTRADICTORY), sql_lit(V.MSG_NO_PLAN)
    dup = sql_fmt(V.MSG_DUPLICATE, w2, f"{w1} || '.ts, ' || {w2} || '.ts'")
    imp_brand = sql_fmt(V.MSG_IMPORTED, "1", "p_brand")
    imp_type = sql_fmt(V.MSG_IMPORTED, "1", "p_type")
    local = sql_fmt(V.MSG_UNVERIFIED, "1", "'helper'")
    sep = "' | '"
    return f"""
WITH pa AS (
  SELECT p_brand AS repo, 'part/' || CAST(p_partkey AS VARCHAR) AS path, p_type, p_name,
         p_brand, p_size, (p_size > 20 OR p_size = 6) AS hd, {RAW_ANSWER_SQL} AS raw FROM part),
pv AS (
  SELECT repo, path, p_type, p_name, p_size, hd,
    CASE WHEN p_size IN (4, 5) THEN {sql_lit(V.MSG_FAILED + V.MSG_PARSE)} || left(raw, 300)
         WHEN p_size >= 45 THEN {sql_lit(V.MSG_FAILED + V.MSG_MISSING + 'driftSummary'
                                         + V.MSG_MISSING_RAW)} || left(raw, 500)
         WHEN hd AND p_type IN ('PROMO', 'STANDARD') THEN {sql_lit(V.MSG_FAILED + V.MSG_BAD_SPLIT)}
    END AS err,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN (CASE WHEN hd THEN {noplan} ELSE NULL END)
         WHEN NOT hd THEN {contra}
         WHEN p_type = 'LARGE' THEN {dup} || {sep} || {imp_brand}
         WHEN p_type = 'MEDIUM' THEN {imp_type} || {sep} || {local}
    END AS warn,
    CASE WHEN p_type = 'SMALL' THEN 0 WHEN p_type = 'ECONOMY' OR NOT hd THEN NULL
         WHEN p_type = 'LARGE' THEN 2 WHEN p_type = 'MEDIUM' THEN 1 END AS n_split
  FROM pa),
allv AS (
  SELECT repo, path, err IS NOT NULL AS is_error,
    CASE WHEN err IS NULL THEN p_type ELSE 'ERROR' END AS inferred_original_purpose,
    CASE WHEN err IS NOT NULL THEN '' WHEN p_size = 8 THEN p_name ELSE replace(p_name, ' ', '; ') END AS responsibilities,
    CASE WHEN err IS NULL THEN hd ELSE false END AS has_drifted,
    COALESCE(err, p_name) AS drift_summary,
    CASE WHEN err IS NULL THEN n_split END AS n_split,
    CASE WHEN err IS NULL THEN COALESCE(warn, '') ELSE '' END AS warnings_text
  FROM pv
  UNION ALL
  SELECT 'conversations', 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR),
    true, 'ERROR', '', false, {sql_lit(V.MSG_FAILED + V.MSG_PARSE)} || left(text, 300), NULL, ''
  FROM conversations)
"""


def _validation_view(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", "path", "is_error", "inferred_original_purpose",
        F.array_join("current_responsibilities", "; ").alias("responsibilities"), "has_drifted", "drift_summary",
        F.when(F.col("suggested_split").isNull(), F.lit(None).cast("int"))
        .otherwise(F.size("suggested_split")).alias("n_split"),
        F.array_join("warnings", " | ").alias("warnings_text"))


@register("validation_full", _sql_validation() + "SELECT * FROM allv")
def q_validation_full(spark, d):
    return _validation_view(validated(spark, d))


@register("verdict_consistency", _sql_validation() + f"""
SELECT repo, path, has_drifted,
  CASE WHEN starts_with(warnings_text, 'Model reported hasDrifted:false') THEN 'contradictory'
       WHEN starts_with(warnings_text, 'Model reported hasDrifted:true') THEN 'no_plan'
       ELSE 'consistent' END AS consistency
FROM allv WHERE NOT is_error
""")
def q_verdict_consistency(spark, d):
    from faultline.operators import validation as V
    v = validated(spark, d).filter(~F.col("is_error"))
    first = F.element_at(F.concat("warnings", F.array(F.lit(""))), 1)
    return v.select("repo", "path", "has_drifted", F.when(first == V.MSG_CONTRADICTORY, "contradictory")
                    .when(first == V.MSG_NO_PLAN, "no_plan").otherwise("consistent").alias("consistency"))


@register("drift_summary", _sql_validation() + """
SELECT repo, count(*) AS analyzed, count(*) FILTER (WHERE has_drifted) AS drifted,
       count(*) FILTER (WHERE is_error) AS errored,
       count(*) FILTER (WHERE warnings_text <> '') AS with_warnings,
       count(*) > 0 AND count(*) FILTER (WHERE is_error) = count(*) AS all_failed
FROM allv GROUP BY repo
""")
def q_drift_summary(spark, d):
    from faultline.operators.validation import drift_summary
    return drift_summary(validated(spark, d), keys=("repo",))


@register("json_required", """
SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS is_object,
       CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN array_to_string(
         list_filter(['k', 'v', 'w'], lambda x: NOT list_contains(json_keys(props), x)), ', ') END AS missing
FROM events
""")
def q_json_required(spark, d):
    from faultline.operators.validation import required_fields
    # a list around the object, or a second value behind it, is no object
    text = F.expr("CASE WHEN event_id % 5 = 0 THEN '[' || props || ']' WHEN event_id % 7 = 0 THEN props || ' 1' ELSE props END")
    checked = required_fields(table(spark, d, "events").select("event_id", text.alias("raw_text")), required=["k", "v", "w"])
    return checked.select("event_id", "is_object", F.array_join("missing", ", ").alias("missing"))


# ---------------------------------------------------------------- A8 / J4 relational

from faultline.operators.validation import MSG_DUPLICATE  # noqa: E402


def _line_occurrences(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("entry"),
                     F.col("l_partkey").alias("symbol"), "l_returnflag",
                     B.line_position().alias("pos"))


@register("split_duplicates", f"""
WITH ep AS (
  SELECT l_orderkey, l_suppkey,
         min(l_linenumber * 100000000000000 + l_suppkey * 10000000 + l_partkey) AS e_pos
  FROM lineitem GROUP BY 1, 2),
occ AS (
  SELECT l.l_orderkey, l.l_suppkey, l.l_partkey, l.l_linenumber, ep.e_pos
  FROM lineitem l JOIN ep USING (l_orderkey, l_suppkey))
SELECT l_orderkey AS answer, l_partkey AS symbol, count(*) AS n,
  string_agg(CAST(l_suppkey AS VARCHAR), ', ' ORDER BY e_pos, l_linenumber, l_suppkey, l_partkey)
    AS files,
  {sql_fmt(MSG_DUPLICATE, "l_partkey", "string_agg(CAST(l_suppkey AS VARCHAR), ', ' ORDER BY e_pos, l_linenumber, l_suppkey, l_partkey)")} AS warning
FROM occ GROUP BY 1, 2 HAVING count(*) > 1
""")
def q_split_duplicates(spark, d):
    from faultline.operators.splits import split_duplicates
    return split_duplicates(_line_occurrences(spark, d))


def _sql_membership() -> str:
    from faultline.operators import validation as V
    imp = sql_fmt(V.MSG_IMPORTED, "n", "symbols")
    loc = sql_fmt(V.MSG_UNVERIFIED, "n", "symbols")
    return f"""
WITH firsts AS (
  SELECT l_orderkey AS answer, l_partkey AS symbol,
         min(l_linenumber * 100000000000000 + l_suppkey * 10000000 + l_partkey) AS p
  FROM lineitem GROUP BY 1, 2),
ex AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'R'),
im AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'A'),
hx AS (SELECT DISTINCT answer FROM ex),
foreign_s AS (
  SELECT f.* FROM firsts f WHERE f.answer IN (SELECT answer FROM hx)
    AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.answer = f.answer AND ex.symbol = f.symbol)),
kinds AS (
  SELECT answer, symbol, p,
    CASE WHEN EXISTS (SELECT 1 FROM im WHERE im.answer = s.answer AND im.symbol = s.symbol)
         THEN 'imported' ELSE 'unverified' END AS kind
  FROM foreign_s s),
g AS (
  SELECT answer, kind, count(*) AS n,
         string_agg(CAST(symbol AS VARCHAR), ', ' ORDER BY p) AS symbols
  FROM kinds GROUP BY 1, 2)
SELECT answer, kind, n, symbols,
       CASE WHEN kind = 'imported' THEN {imp} ELSE {loc} END AS warning FROM g
UNION ALL
SELECT DISTINCT l_orderkey, 'no_exports', 0, '', {sql_lit(V.MSG_NO_EXPORTS)}
FROM lineitem WHERE l_orderkey NOT IN (SELECT answer FROM hx)
"""


@register("symbol_membership", _sql_membership())
def q_symbol_membership(spark, d):
    from faultline.operators.splits import symbol_membership
    occ = _line_occurrences(spark, d)
    return symbol_membership(
        occ, occ.filter(F.col("l_returnflag") == "R"), occ.filter(F.col("l_returnflag") == "A"))


# ---------------------------------------------------------------- P1 / P2 / P14 on documents

# Decision-point tokens both Java regex and RE2 read the same way (no
# lookaround), for the documents binding; the TypeScript default is
# faultline.functions.text.DECISION_POINT.
PORTABLE_MASK = (r"//[^\n]*|/\*[\s\S]*?\*/|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
                 r"|" + '"' + r"[^" + '"' + r"\\\n]*(?:\\.[^" + '"' + r"\\\n]*)*" + '"')
PORTABLE_TOKENS = (r"if[ \t\r\n]*\(|for[ \t\r\n]*\(|while[ \t\r\n]*\(|case[ \t\r\n]"
                   r"|catch[ \t\r\n]*[({]|&&|\|\||\?\?|\?")


@register("line_count", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines
FROM documents
""")
def q_line_count(spark, d):
    from faultline.functions.text import line_count
    return table(spark, d, "documents").select("doc_id", line_count("text").alias("lines"))


@register("decision_points", f"""
SELECT doc_id, CAST(len(regexp_extract_all(
  regexp_replace(text, {sql_lit(PORTABLE_MASK)}, ' ', 'g'), {sql_lit(PORTABLE_TOKENS)})) + 1
  AS INTEGER) AS complexity
FROM documents
""")
def q_decision_points(spark, d):
    from faultline.functions.text import decision_points
    masked = F.regexp_replace("text", PORTABLE_MASK, " ")
    return table(spark, d, "documents").select(
        "doc_id", decision_points(masked, PORTABLE_TOKENS).alias("complexity"))


PROMPT_CAP = _prompt.MAX_SOURCE_CHARS


def sql_prompt(path: str, exports: str, touches: str, text: str) -> str:
    """SQL text of the prompt; ``exports`` is a JSON array, ``touches`` may be null."""
    return f"""'File path: ' || {path} || chr(10) || 'Exported symbols: ' || {exports} || chr(10)
  || CASE WHEN {touches} IS NULL THEN {sql_lit(_prompt.TOUCH_UNKNOWN)} ELSE {sql_fmt(_prompt.TOUCH_KNOWN, touches)} END
  || chr(10) || chr(10) || 'Source:' || chr(10) || '```typescript' || chr(10)
  || CASE WHEN length({text}) > {PROMPT_CAP} THEN left({text}, {PROMPT_CAP}) || {sql_lit(_prompt.TRUNCATION_NOTE)} ELSE {text} END
  || chr(10) || '```'"""


@register("prompt_build", f"""
SELECT doc_id, length(text) > {PROMPT_CAP} AS truncated,
  {sql_prompt("'doc/' || CAST(doc_id AS VARCHAR)", "CAST(to_json([lang, source]) AS VARCHAR)", "CASE WHEN lang <> 'de' THEN n_chars END", "text")} AS prompt
FROM documents
""")
def q_prompt_build(spark, d):
    from faultline.functions.prompt import build_prompt
    docs = table(spark, d, "documents")
    touch = F.when(F.col("lang") != "de", F.col("n_chars"))
    return docs.select("doc_id", (F.length("text") > PROMPT_CAP).alias("truncated"),
                       build_prompt(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")),
                                    F.array("lang", "source"), F.col("text"), touch,
                                    PROMPT_CAP).alias("prompt"))


# ---------------------------------------------------------------- link fan-in (P4 + A1)

HREF = r'href="([^"]*)"'


@register("link_fan_in", f"""
SELECT target, count(DISTINCT page_id) AS fan_in FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {sql_lit(HREF)}, 1)) AS target FROM pages)
GROUP BY target
""")
def q_link_fan_in(spark, d):
    pages = table(spark, d, "pages")
    edges = pages.select(F.col("page_id").alias("src_path"),
                         F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("target"))
    return graph.fan_in_counts(edges, keys=(), dst="target", drop_self=False)


# ---------------------------------------------------------------- E1 scan report

@register("scan_report", SQL_MM + SQL_BASE + SQL_DELTA + f"""
, tops AS (
  SELECT s.*, d.is_new, d.lines_delta, d.complexity_delta,
         row_number() OVER (PARTITION BY s.repo ORDER BY s.score DESC, s.path) AS rank
  FROM scored s JOIN dl d USING (repo, path)),
flags AS (SELECT repo, bool_or(touch_count IS NOT NULL) AS has_touch_data FROM mm GROUP BY repo)
SELECT t.repo, t.path, t.rank, CAST(round(t.score) AS INTEGER) AS display_score,
       t.complexity, t.lines, t.fan_in,
       CASE WHEN f.has_touch_data THEN COALESCE(CAST(t.touch_count AS VARCHAR), '?') END AS touches,
       CAST(len(string_split(t.p_name, ' ')) AS INTEGER) AS export_count,
       CASE WHEN t.is_new THEN 'NEW' ELSE 'Δcomplexity=' || {_sql_label('t.complexity_delta')}
            || ' Δlines=' || {_sql_label('t.lines_delta')} END AS delta_text,
       t.has_syntax_errors
FROM tops t JOIN flags f USING (repo) WHERE t.rank <= {TOPK_PER_REPO}
""")
def q_scan_report(spark, d):
    from faultline.plans.jobs import scan_report
    current, base = module_snapshots(spark, d)
    res = scan_report(scoring.with_score(current), base, k=TOPK_PER_REPO,
                      keys=("repo",), rel_path="path")
    return res.top.select("repo", "path", "rank", "display_score",
                          "complexity", "lines", "fan_in", "touches", "export_count",
                          "delta_text", "has_syntax_errors")


# ---------------------------------------------------------------- J1 on written specifiers

SQL_MODULE_PATH = """
  'src/' || lower({t}) || '/' || CAST({pk} AS VARCHAR)
  || CASE WHEN {sz} > 40 THEN '/index.ts' WHEN {sz} > 30 THEN '.tsx' ELSE '.ts' END"""


@register("import_resolution", "WITH " + SQL_FILES + "," + SQL_FIRST_LINE.replace(
    "WHERE i.src <> l.l_partkey GROUP BY 1", "WHERE i.src <> l.l_partkey AND l.l_linenumber NOT IN (6, 7) GROUP BY 1")
    + f"""
SELECT 'parts' AS repo,
  {SQL_MODULE_PATH.format(t='p.p_type', pk='p.p_partkey', sz='p.p_size')} AS path,
  COALESCE(fan.fan_in, 0) AS fan_in
FROM part p LEFT JOIN fan ON fan.path = p.p_partkey
""")
def q_import_resolution(spark, d):
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    files = B.part_module_files(part)
    edges = graph.resolve_import_rows(B.first_line_import_decls(li, part), files)
    return graph.fan_in(files, edges).select("repo", "path", "fan_in")


# ---------------------------------------------------------------- P5 on prose and page scripts

# Comments and strings without possessive quantifiers and look-behind: the loops
# are unrolled (unambiguous), so Java and RE2 match the same spans. The shipped
# mask is exercised by source_metrics.
PORTABLE_CODE_MASK = ("(?s)" + _tx.COMMENTS + "|" + _tx.STRINGS).replace("*+", "*").replace(r"(?<![\w$])", "")
PORTABLE_LEFTOVER = r"['\"`]|/\*"


def _sql_integrity(col: str) -> str:
    masked = f"regexp_replace({col}, {sql_lit(PORTABLE_CODE_MASK)}, ' ', 'g')"
    br = f"regexp_replace({masked}, '[^()\\[\\]{{}}]', '', 'g')"
    fold = (f"list_reduce(list_filter(string_split({br}, ''), lambda x: x <> ''), "
            "lambda acc, c: CASE WHEN left(acc, 1) = '!' THEN acc "
            "WHEN c IN ('(', '[', '{') THEN acc || c "
            "WHEN length(acc) > 1 AND right(acc, 1) = CASE c WHEN ')' THEN '(' "
            "WHEN ']' THEN '[' ELSE '{' END THEN left(acc, length(acc) - 1) ELSE '!' END, '#')")
    return (f"(regexp_matches({masked}, '[''\"`]|/\\*') OR {fold} <> '#')")


@register("syntax_integrity", f"""
SELECT doc_id, {_sql_integrity('text')} AS has_syntax_errors FROM documents
""")
def q_syntax_integrity(spark, d):
    masked = F.regexp_replace("text", PORTABLE_CODE_MASK, " ")
    return table(spark, d, "documents").select(
        "doc_id", _tx.has_syntax_errors(masked, PORTABLE_LEFTOVER).alias("has_syntax_errors"))


SCRIPT = r"(?s)<script>(.*?)</script>"


@register("script_integrity", f"""
SELECT page_id, pos, {_sql_integrity('code')} AS has_syntax_errors,
       CAST(len(regexp_extract_all(regexp_replace(code, {sql_lit(PORTABLE_CODE_MASK)}, ' ', 'g'),
            {sql_lit(PORTABLE_TOKENS)})) + 1 AS INTEGER) AS complexity
FROM (SELECT page_id, unnest(regexp_extract_all(html, {sql_lit(SCRIPT)}, 1)) AS code,
             generate_subscripts(regexp_extract_all(html, {sql_lit(SCRIPT)}, 1), 1) - 1 AS pos
      FROM pages)
""")
def q_script_integrity(spark, d):
    from faultline.functions.text import decision_points
    pages = table(spark, d, "pages")
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), 1))
                           .alias("pos", "code"))
    masked = F.regexp_replace("code", PORTABLE_CODE_MASK, " ")
    return scripts.select("page_id", F.col("pos").cast("long").alias("pos"),
                          _tx.has_syntax_errors(masked, PORTABLE_LEFTOVER).alias("has_syntax_errors"),
                          decision_points(masked, PORTABLE_TOKENS).alias("complexity"))


# ---------------------------------------------------------------- A3 / A4 / A5 / P15 totals

@register("scan_totals", SQL_MM + f"""
SELECT repo, count(*) AS files_scanned, least(count(*), {TOPK_PER_REPO}) AS shown,
       count(*) FILTER (WHERE has_syntax_errors) AS broken,
       bool_or(touch_count IS NOT NULL) AS has_touch_data,
       '1995-02-01' AS baseline_date
FROM mm GROUP BY repo
""")
def q_scan_totals(spark, d):
    from faultline.plans.jobs import scan_report
    current, base = module_snapshots(spark, d)
    res = scan_report(scoring.with_score(current), base, k=TOPK_PER_REPO, keys=("repo",),
                      rel_path="path")
    return res.totals


# ---------------------------------------------------------------- J5 + E4: answers for candidates

ANSWERED_TYPES = "p_type <> 'STANDARD'"   # STANDARD parts got no answer


def _answer_rows(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_brand").alias("repo"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"),
        F.expr(RAW_ANSWER_SQL).alias("raw_text"))


@register("answer_pairing", SQL_MM + ", " + _sql_validation().strip()[len("WITH "):] + f"""
, cand AS (
  SELECT repo, path FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rk
    FROM scored WHERE NOT has_syntax_errors)
  WHERE rk <= {DRIFT_K} AND lines >= {DRIFT_MIN_LINES} AND complexity >= {DRIFT_MIN_COMPLEXITY})
SELECT c.repo, 'part/' || CAST(c.path AS VARCHAR) AS path,
  CASE WHEN {ANSWERED_TYPES} THEN a.is_error ELSE true END AS is_error,
  CASE WHEN {ANSWERED_TYPES} THEN a.inferred_original_purpose ELSE 'ERROR' END
    AS inferred_original_purpose,
  CASE WHEN {ANSWERED_TYPES} THEN a.responsibilities ELSE '' END AS responsibilities,
  CASE WHEN {ANSWERED_TYPES} THEN a.has_drifted ELSE false END AS has_drifted,
  CASE WHEN {ANSWERED_TYPES} THEN a.drift_summary
       ELSE 'Analysis failed: No model answer for this file' END AS drift_summary,
  CASE WHEN {ANSWERED_TYPES} THEN a.n_split END AS n_split,
  CASE WHEN {ANSWERED_TYPES} THEN a.warnings_text ELSE '' END AS warnings_text
FROM cand c JOIN part p ON p.p_partkey = c.path
LEFT JOIN allv a ON a.path = 'part/' || CAST(c.path AS VARCHAR)
""")
def q_answer_pairing(spark, d):
    from faultline.operators.candidates import drift_candidates
    from faultline.operators.validation import pair_answers, validate_paired
    cand = (drift_candidates(scored_modules(spark, d), DRIFT_K, DRIFT_MIN_LINES,
                             DRIFT_MIN_COMPLEXITY)
            .filter(F.col("status") == "candidate")
            .select("repo", F.concat(F.lit("part/"), F.col("path").cast("string")).alias("path"),
                    "exported_symbols", "imported_symbol_names"))
    responses = _answer_rows(table(spark, d, "part").filter(F.expr(ANSWERED_TYPES)))
    return _validation_view(validate_paired(pair_answers(cand, responses, keys=("repo",))))


# ---------------------------------------------------------------- P1-P5, J1, A1, E1, E3, E5 on source text

SQL_SOURCES = f"""
WITH src AS (
  SELECT p_partkey AS k, p_size AS s, p_type AS t, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         {B.SOURCE_PATH_SQL} AS path, {B.SOURCE_SQL} AS content,
         p_type = 'PROMO' AND p_size >= 45 AS broken FROM part),
met AS (
  SELECT *, CAST(6 + s % 7 + CASE WHEN t IN ('SMALL', 'LARGE', 'MEDIUM', 'STANDARD') THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 AND k <> 0 THEN 1 ELSE 0 END
              + CASE WHEN k % 6 = 1 THEN 3 ELSE 0 END + CASE WHEN k % 7 = 3 THEN 2 ELSE 0 END + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END
              + CASE WHEN k % 13 = 5 THEN 2 ELSE 0 END + CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS lines,
         CAST(2 + s % 7 + CASE WHEN t IN ('SMALL', 'LARGE') THEN 2 WHEN t IN ('MEDIUM', 'STANDARD') THEN 1 ELSE 0 END
              + CASE WHEN k % 3 = 0 AND k <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END AS INTEGER) AS complexity,
         [w1 || CAST(k AS VARCHAR), w2 || CAST(k AS VARCHAR)] || CASE WHEN k % 6 = 1 THEN ['I1'] ELSE [] END
           || CASE WHEN k % 13 = 5 THEN ['b1', 'c1', 'd1', 'A1'] ELSE [] END || CASE WHEN broken THEN ['broken'] ELSE [] END AS own FROM src),
edge AS (
  SELECT k AS a, k - s AS b FROM src WHERE k - s >= 1 UNION SELECT k, 0 FROM src WHERE k % 5 = 0 AND k <> 0),
fans AS (SELECT b AS k, count(DISTINCT a) AS fan_in FROM edge GROUP BY 1),
star AS (SELECT k AS a, k - 1 AS b FROM src WHERE k % 4 IN (1, 2) AND k > 1),
reach AS (SELECT a, b FROM star UNION SELECT x.a, y.b FROM star x JOIN star y ON x.b = y.a),
more AS (
  SELECT a AS k, list_sort(list_distinct(flatten(list(own)))) AS names FROM reach JOIN met ON met.k = reach.b GROUP BY 1),
scanned AS (
  SELECT met.*, COALESCE(fans.fan_in, 0) AS fan_in,
         own || list_filter(COALESCE(more.names, []), lambda n: NOT list_contains(own, n)) AS exports
  FROM met LEFT JOIN fans USING (k) LEFT JOIN more USING (k))
"""


def _sources(spark, d):
    return B.part_sources(table(spark, d, "part"))


@register("source_metrics", SQL_SOURCES + """
SELECT path, lines, complexity, array_to_string(own, ',') AS exports,
       CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS import_count,
       './m' || CAST(k - s AS VARCHAR) || CASE WHEN k % 5 = 0 THEN ',.' ELSE '' END AS imported_from,
       w1 || ',' || w2 AS imported, broken AS has_syntax_errors
FROM met
""")
def q_source_metrics(spark, d):
    from faultline.operators.metrics import file_metrics
    m = file_metrics(_sources(spark, d))
    return m.select("path", "lines", "complexity", F.array_join("exported_symbols", ",").alias("exports"), "import_count",
                    F.array_join("imported_from", ",").alias("imported_from"),
                    F.array_join("imported_symbol_names", ",").alias("imported"), "has_syntax_errors")


@register("source_scan", SQL_SOURCES + """
SELECT path, replace(path, 'C:/w/', '') AS rel_path, lines, complexity, fan_in, array_to_string(exports, ',') AS exports FROM scanned
""")
def q_source_scan(spark, d):
    from faultline.operators.metrics import scan
    return scan(_sources(spark, d)).select("path", "rel_path", "lines", "complexity", "fan_in",
                                           F.array_join("exported_symbols", ",").alias("exports"))


def _source_commits(spark, d):
    """History lines of the parts' files, with the drive spelled as a prefix."""
    return table(spark, d, "lineitem").filter(F.col("l_shipdate") < B.cut(B.TOUCH_CUT)).select(
        F.lit("parts").alias("repo"), F.col("l_orderkey").alias("commit_id"),
        F.expr("CASE WHEN l_partkey = 0 THEN '/c/w/src/index.ts' ELSE '/c/w/src/m' || CAST(l_partkey AS VARCHAR(20)) || "
               + B.SOURCE_SUFFIX_SQL.format("l_partkey") + " END").alias("path"))


PROMPT_K, PROMPT_LINES, PROMPT_COMPLEXITY = 40, 11, 6


@register("drift_prompts", SQL_SOURCES + "," + SQL_TOUCH + f""",
ranked AS (
  SELECT sc.*, COALESCE(tch.touches, 0) AS touch_count, row_number() OVER (
    ORDER BY complexity * 2 + lines * 0.1::DOUBLE + fan_in * 3 + COALESCE(tch.touches, 0) * 2 DESC, sc.path) AS rank
  FROM scanned sc LEFT JOIN tch ON tch.path = sc.k WHERE NOT broken)
SELECT path, rank, {sql_prompt("path", "CAST(to_json(exports) AS VARCHAR)", "touch_count", "content")} AS prompt
FROM ranked WHERE rank <= {PROMPT_K} AND lines >= {PROMPT_LINES} AND complexity >= {PROMPT_COMPLEXITY}
""")
def q_drift_prompts(spark, d):
    from faultline.plans import jobs
    files = _sources(spark, d)
    scored = jobs.scored_files(files, _source_commits(spark, d))
    return jobs.drift_prompts(scored, files, PROMPT_K, PROMPT_LINES, PROMPT_COMPLEXITY).select(
        "path", F.col("rank").cast("long").alias("rank"), "prompt")


@register("forest_prompts", ORACLE["drift_prompts"])
def q_forest_prompts(spark, d):
    """The parts' files written as a tree, scanned as a forest; only the candidates' files are opened again."""
    from faultline.plans import jobs
    from faultline.sources.source_tree import read_source_forest, write_source_tree
    at = _fresh(spark, "forest")
    write_source_tree(_sources(spark, d).withColumn("rel_path", F.concat(F.lit("parts/"), F.col("rel_path"))), at)
    files = read_source_forest(spark, at)
    top = F.regexp_extract("path", "^(.*/)parts/src/[^/]*$", 1)
    commits = _source_commits(spark, d).withColumn("path", F.regexp_replace("path", "^/c/w/", ""))
    # History lines name files from their repository's root.
    rooted = files.select("repo", F.concat(top, F.lit("parts/")).alias("root")).limit(1)
    commits = commits.join(rooted, "repo").withColumn("path", F.concat("root", "path")).drop("root")
    scored = jobs.scored_files(files, commits)
    return jobs.drift_prompts(scored, at, PROMPT_K, PROMPT_LINES, PROMPT_COMPLEXITY).select(
        F.concat(F.lit("C:/w/"), F.col("rel_path")).alias("path"), F.col("rank").cast("long").alias("rank"),
        F.replace("prompt", F.concat(top, F.lit("parts/")), F.lit("C:/w/")).alias("prompt"))


@register("incremental_scan", SQL_SOURCES + """
SELECT path, lines, complexity, fan_in, array_to_string(exports, ',') AS exports, CAST(1 AS BIGINT) AS parsed FROM scanned
""")
def q_incremental_scan(spark, d):
    """A snapshot of two thirds of the files, then one of all: the second parses only the rest.
    ``parsed`` is how many rows of the store hold the file's content."""
    from faultline.operators.metric_store import fingerprint, measured_files
    from faultline.operators.metrics import scan
    at = _fresh(spark, "metric-store")
    files = _sources(spark, d)
    measured_files(files.filter("length(path) % 3 <> 0 OR path LIKE '%7%'"), store=at).count()
    found = scan(files, store=at)
    held = spark.read.parquet(at).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("parsed"))
    prints = files.select("path", fingerprint().alias("fingerprint")).join(held, "fingerprint", "left")
    return found.join(prints, "path").select("path", "lines", "complexity", "fan_in", F.array_join("exported_symbols", ",").alias("exports"), "parsed")


def _source_changes(spark, d, by_path=False):
    """Staged changes: each order line changes its part's file (open lines) or a script. They are
    dealt out by part, whose file is written once for all its lines, or by ranges of path and commit:
    one path may have half of the lines."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    path = F.when(F.col("l_linestatus") == "O", F.expr(B.SOURCE_PATH_SQL)).otherwise("C:/w/run.js")
    if by_path:
        # Few narrow rows become much text: adaptive execution must not make one task of them.
        wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        x = li.join(part, li.l_partkey == part.p_partkey).withColumn("path", path).repartitionByRange(wide, "path", "l_orderkey")
        x = x.withColumn("content", F.expr(B.SOURCE_SQL))
    else:
        # Never broadcast, as the texts are many times what their columns take; a part of many lines is split by adaptive execution.
        texts = part.withColumn("content", F.expr(B.SOURCE_SQL)).hint("merge")
        x = li.join(texts, li.l_partkey == texts.p_partkey).withColumn("path", path)
    return x.select(F.lit("parts").alias("repo"), F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_returnflag").alias("status"), "path", "content")


SQL_CHANGES = SQL_SOURCES + f""",
verdict AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS commit_id, count(*) AS n_checked,
         count(*) FILTER (WHERE lines >= {PROMPT_LINES} AND complexity >= {PROMPT_COMPLEXITY}) AS n_flagged,
         bool_or(lines >= {PROMPT_LINES} AND complexity >= {PROMPT_COMPLEXITY} AND l_orderkey % 2 = 0) AS failed
  FROM lineitem JOIN met ON met.k = l_partkey WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'C', 'M') GROUP BY 1)
"""


@register("gate_changes", SQL_CHANGES + "SELECT * FROM verdict")
def q_gate_changes(spark, d):
    from faultline.plans import jobs
    _, verdict = jobs.gate(_source_changes(spark, d), PROMPT_LINES, PROMPT_COMPLEXITY,
                           strict=F.col("commit_id").cast("long") % 2 == 0)
    return verdict.drop("repo")


# ---------------------------------------------------------------- sinks and sources: written, then read back

def _fresh(spark, name):
    import uuid
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("baseline_round_trip", ORACLE["baseline_snapshot"])
def q_baseline_round_trip(spark, d):
    from faultline.sources import baseline_store as BS
    at = _fresh(spark, "baseline")
    BS.save_baseline(baseline_snapshot(spark, d).withColumn("rel_path", F.col("rel_path").cast("string")), at)
    return BS.load_baseline(spark, at).withColumn("rel_path", F.col("rel_path").cast("long")).drop("created_at", "tool_version")


@register("commit_log", """
SELECT 'parts' || CAST(l_partkey % 3 AS VARCHAR) AS repo, '/w/src/m' || CAST(l_partkey AS VARCHAR) || '.ts' AS path, count(*) AS touches
FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY 1, 2
""")
def q_commit_log(spark, d):
    from faultline.sources.history_log import read_commit_log
    at = _fresh(spark, "commit-log")
    table(spark, d, "lineitem").select(
        F.concat(F.lit("parts"), (F.col("l_partkey") % 3).cast("string")).alias("repo"),
        F.expr("CASE l_linenumber % 3 WHEN 1 THEN 'src/m.js' ELSE ' src/m' || CAST(l_partkey AS VARCHAR(20)) || '.ts' END").alias("value")
    ).write.partitionBy("repo").text(at)
    roots = spark.range(3).select(F.concat(F.lit("parts"), F.col("id").cast("string")).alias("repo"), F.lit("/w/").alias("git_root"))
    return history.touch_frequency(read_commit_log(spark, at, roots), commit=None)


@register("answers_round_trip", _sql_validation() + "SELECT repo, path, is_error, drift_summary, warnings_text FROM allv WHERE repo <> 'conversations'")
def q_answers_round_trip(spark, d):
    from faultline.operators.validation import validate_answers
    from faultline.sources.answers import read_responses, write_analyses
    at = _fresh(spark, "responses")
    given = part_answers(spark, d).filter("repo <> 'conversations'")
    given.select("repo", "path", "raw_text").write.parquet(at)
    answers = read_responses(spark, at).join(given.drop("raw_text"), ["repo", "path"])
    out = _fresh(spark, "analyses")
    write_analyses(_validation_view(validate_answers(answers)).select("repo", "path", "is_error", "drift_summary", "warnings_text"), out)
    return spark.read.schema("path string, is_error boolean, drift_summary string, warnings_text string, repo string").json(out).select(
        "repo", "path", "is_error", "drift_summary", "warnings_text")


@register("gate_stream", SQL_CHANGES + "SELECT * FROM verdict")
def q_gate_stream(spark, d):
    from faultline.streaming.gate_stream import read_gate_verdicts, start_gate_verdict_stream
    at = _fresh(spark, "staged-changes")
    changes = _source_changes(spark, d, by_path=True)
    changes.write.parquet(at)
    # a commit's files are in several files, which arrive in three batches
    files = len(spark.read.schema(changes.schema).parquet(at).inputFiles())
    query = start_gate_verdict_stream(spark, at, f"{at}-status", f"{at}-verdict", name=at.rsplit("/", 1)[-1], available_now=True,
                                      max_files_per_trigger=max(1, -(-files // 3)), min_lines=PROMPT_LINES, min_complexity=PROMPT_COMPLEXITY,
                                      strict=F.col("commit_id").cast("long") % 2 == 0)
    query.awaitTermination()
    return read_gate_verdicts(spark, f"{at}-verdict").drop("repo")


# The first change of a (commit, part) is the one that counts: its lines repeat in the second and third delivery.
@register("commit_verdicts", SQL_SOURCES + f"""
SELECT CAST(l_orderkey AS VARCHAR) AS commit_id, count(DISTINCT l_partkey) AS n_checked,
       count(DISTINCT l_partkey) FILTER (WHERE lines >= {PROMPT_LINES} AND complexity >= {PROMPT_COMPLEXITY}) AS n_flagged,
       bool_or(lines >= {PROMPT_LINES} AND complexity >= {PROMPT_COMPLEXITY} AND l_orderkey % 2 = 0) AS failed
FROM lineitem JOIN met ON met.k = l_partkey WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'C', 'M') GROUP BY 1
""")
def q_commit_verdicts(spark, d):
    """Changes in three deliveries, the stream stopped and resumed between them: odd lines, all
    lines (so odd ones repeat), and a change of a later day, which lets the watermark close all commits before."""
    from faultline.streaming.gate_stream import start_commit_verdict_stream
    at = _fresh(spark, "timed-changes")
    timed = _source_changes(spark, d).withColumn("staged_at", F.timestamp_seconds(
        F.lit(1_700_000_000) + F.pmod(F.xxhash64("commit_id"), F.lit(3600))))
    later = spark.createDataFrame([("parts", "-1", "A", "later.ts", "")], "repo string, commit_id string, status string, path string, content string").withColumn(
        "staged_at", F.timestamp_seconds(F.lit(1_700_500_000)))
    for delivery in (timed.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == 1), timed, later):
        delivery.write.mode("append").parquet(at)
        start_commit_verdict_stream(spark, at, f"{at}-verdict", name=at.rsplit("/", 1)[-1], available_now=True, late="2 hours", min_lines=PROMPT_LINES,
                                    min_complexity=PROMPT_COMPLEXITY, strict=F.col("commit_id").cast("long") % 2 == 0).awaitTermination()
    return spark.read.schema("repo string, commit_id string, closed_at timestamp, n_checked long, n_flagged long, failed boolean").parquet(f"{at}-verdict").select(
        "commit_id", "n_checked", "n_flagged", "failed")


# ---------------------------------------------------------------- any number of snapshots, versions of a baseline

SNAPSHOT_DATES = ["1993-06-01", "1995-02-01", "1996-12-31", "1999-01-01"]


@register("baseline_history", f"""
WITH cuts AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in SNAPSHOT_DATES)}]) AS at),
lines AS (SELECT l_partkey AS path, l_orderkey AS o, l_suppkey AS s, l_shipdate AS at FROM lineitem),
now AS (SELECT path, count(DISTINCT o) AS touches, count(DISTINCT s) AS fan_in FROM lines GROUP BY 1),
past AS (SELECT path, cuts.at, count(DISTINCT o) AS touches, count(DISTINCT s) AS fan_in FROM lines JOIN cuts ON lines.at < cuts.at GROUP BY 1, 2)
SELECT p_brand AS repo, p_partkey AS path, strftime(cuts.at, '%Y-%m-%d') AS snapshot, COALESCE(past.touches, 0) AS touches, COALESCE(past.fan_in, 0) AS fan_in,
       COALESCE(now.touches, 0) - COALESCE(past.touches, 0) AS touches_delta, COALESCE(now.fan_in, 0) - COALESCE(past.fan_in, 0) AS fan_in_delta,
       past.path IS NULL AS is_new
FROM part CROSS JOIN cuts LEFT JOIN past ON past.path = p_partkey AND past.at = cuts.at LEFT JOIN now ON now.path = p_partkey
""")
def q_baseline_history(spark, d):
    """Touches and importers (suppliers) of every part before each of its brand's snapshot dates, from one read of the lines."""
    from faultline.operators.snapshots import cumulative_counts, deltas_over_dates
    files = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("path"))
    events = table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("src_path"),
                                                F.col("l_shipdate").alias("committed_at"))
    cumulated = cumulative_counts(events, {"touches": "commit_id", "fan_in": "src_path"}, keys=())
    dates = files.select("repo").distinct().select("repo", F.explode(F.array(*[B.cut(x) for x in SNAPSHOT_DATES])).alias("committed_at"))
    # A part is of one brand, so its counts carry over.
    owned = cumulated.join(files, "path")
    return deltas_over_dates(owned, files, dates, ["touches", "fan_in"]).select(
        "repo", "path", F.date_format("committed_at", "yyyy-MM-dd").alias("snapshot"), "touches", "fan_in", "touches_delta", "fan_in_delta", "is_new")


@register("baseline_versions", """
SELECT p_brand AS repo, CAST(p_partkey AS VARCHAR) AS rel_path, CAST(CASE WHEN p_brand LIKE '%3' THEN 7 ELSE p_size END AS INTEGER) AS complexity,
       CASE WHEN p_brand LIKE '%3' THEN '2' ELSE '1' END AS tool_version
FROM part WHERE NOT (p_brand LIKE '%3' AND p_size > 25)
""")
def q_baseline_versions(spark, d):
    """A baseline of all brands, a refused second one, a forced one of some brands with fewer
    files, and a write that was never committed; then what a reader sees."""
    from faultline.sources import baseline_store as BS, baseline_versions as BV
    at = _fresh(spark, "baseline-versions")
    rows = B.part_files(table(spark, d, "part")).select(
        "repo", F.col("path").cast("string").alias("rel_path"), "lines", "complexity", F.lit(0).cast("long").alias("fan_in"), F.size("exported_symbols").alias("export_count"),
        F.lit(None).cast("long").alias("touch_count"), F.lit("2026-01-02").cast("timestamp").alias("created_at"), F.lit("1").alias("tool_version"))
    BV.commit_baseline(rows, at)
    some = rows.filter("repo LIKE '%3'").withColumn("tool_version", F.lit("2"))
    try:
        BV.commit_baseline(some, at)
        raise AssertionError("the second baseline was not refused")
    except BS.BaselineExistsError:
        pass
    BV.commit_baseline(some.filter("complexity <= 25").withColumn("complexity", F.lit(7)), at, force=True)
    rows.withColumn("complexity", F.lit(0)).write.partitionBy("repo").parquet(f"{at}/versions/version=never")
    return BV.read_baseline(spark, at).select("repo", "rel_path", "complexity", "tool_version")
