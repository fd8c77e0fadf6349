"""Bindings of the library's tables to the driver's TPC-H-ish tables.

No driver table holds source code, so the operators take column names and
these functions map the driver's columns onto the library's model:

* a *module* (file) is a ``part``: ``repo`` = ``p_brand``, ``path`` =
  ``p_partkey``, ``complexity`` = ``p_size``, ``lines`` = whole part of
  ``p_retailprice``, exports = the words of ``p_name``;
* an *import edge* comes from ``lineitem``: per order, the part on the order's
  first line imports every part on the order (``first_line_edges``), or the
  order itself imports its parts (``order_part_edges``);
* a *commit* is an order: it touches the parts on its lines, committed at
  ``l_shipdate``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Binding parameters (fixed values used by the registered queries).
TOUCH_CUT = "1995-04-01"       # history = lineitems shipped before this
BASELINE_CUT = "1995-02-01"    # baseline snapshot = state before this
NO_HISTORY_SUFFIX = "7"        # brands ending in this digit export no history
BROKEN_TYPE, BROKEN_MIN_SIZE = "PROMO", 45   # "unparseable" modules


def cut(ts: str) -> Column:
    """A wall-clock cut date (``timestamp_ntz``, independent of time zones)."""
    dt.date.fromisoformat(ts)   # validate the literal
    return F.lit(ts).cast("timestamp_ntz")


def line_position() -> Column:
    """A line's place in its order, ``(l_linenumber, l_suppkey, l_partkey)`` as one
    number (line numbers alone repeat): its minimum is a hash aggregate."""
    return F.expr("cast(l_linenumber AS decimal(10,0)) * cast(1000000000000000000000000 AS decimal(25,0))"
                  " + cast(l_suppkey AS decimal(20,0)) * cast(1000000000000 AS decimal(13,0)) + cast(l_partkey AS decimal(20,0))")


def _part_at(position: Column) -> Column:
    return (position % F.expr("cast(1000000000000 AS decimal(13,0))")).cast("long")


def part_files(part: DataFrame) -> DataFrame:
    """``repo, path, lines, complexity, exported_symbols, imported_symbol_names,
    has_syntax_errors``."""
    return part.select(
        F.col("p_brand").alias("repo"),
        F.col("p_partkey").alias("path"),
        F.floor("p_retailprice").cast("int").alias("lines"),
        F.col("p_size").alias("complexity"),
        F.split("p_name", " ").alias("exported_symbols"),
        F.array("p_brand", "p_type").alias("imported_symbol_names"),
        ((F.col("p_type") == BROKEN_TYPE) & (F.col("p_size") >= BROKEN_MIN_SIZE))
        .alias("has_syntax_errors"),
    )


def order_part_edges(lineitem: DataFrame, before: str | None = None) -> DataFrame:
    """``src_path`` = order key, ``dst_path`` = part key, one row per line."""
    li = lineitem if before is None else lineitem.filter(F.col("l_shipdate") < cut(before))
    return li.select(F.col("l_orderkey").alias("src_path"),
                     F.col("l_partkey").alias("dst_path"))


def first_line_edges(lineitem: DataFrame, before: str | None = None) -> DataFrame:
    """Per order the part on its first line imports every part on the order.

    "First" is the least :func:`line_position`. One importer per order (an aggregate, so a
    hot order is combined map-side), then an N:1 join back: no pairs within an
    order are ever formed.
    """
    li = lineitem if before is None else lineitem.filter(F.col("l_shipdate") < cut(before))
    importer = li.groupBy("l_orderkey").agg(_part_at(F.min(line_position())).alias("src_path"))
    return (li.select("l_orderkey", F.col("l_partkey").alias("dst_path"))
            .join(importer, "l_orderkey").select("src_path", "dst_path"))


def lineitem_commits(lineitem: DataFrame, before: str | None = TOUCH_CUT) -> DataFrame:
    """``commit_id, committed_at, path`` from lineitem, optionally before a cut."""
    li = lineitem if before is None else lineitem.filter(F.col("l_shipdate") < cut(before))
    return li.select(F.col("l_orderkey").alias("commit_id"),
                     F.col("l_shipdate").alias("committed_at"),
                     F.col("l_partkey").alias("path"))


def history_brands(part: DataFrame, no_history_suffix: str | None = NO_HISTORY_SUFFIX) -> DataFrame:
    """Repositories whose history was exported."""
    repos = part.select(F.col("p_brand").alias("repo")).distinct()
    if no_history_suffix:
        repos = repos.filter(~F.col("repo").endswith(no_history_suffix))
    return repos


def lineitem_changes(lineitem: DataFrame) -> DataFrame:
    """A staged change per lineitem: ``status`` = ``l_returnflag``, the file is
    ``src/<partkey>.ts`` for open lines and ``.js`` otherwise."""
    ext = F.when(F.col("l_linestatus") == "O", ".ts").otherwise(".js")
    return lineitem.select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_returnflag").alias("status"),
        F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), ext).alias("path"))


def part_states(lineitem: DataFrame) -> DataFrame:
    """``path, fan_in_<now|then>, touches_<now|then>, first_seen``: of every part its
    importers and touching orders now and at the baseline's cut.

    Two reads of the lines: one finds each order's first-line part overall and
    among the lines before the cut, one joins that back and counts everything
    in one aggregate.
    """
    old = F.col("l_shipdate") < cut(BASELINE_CUT)
    importer = lineitem.groupBy("l_orderkey").agg(
        _part_at(F.min(line_position())).alias("now"), _part_at(F.min(F.when(old, line_position()))).alias("then"))
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("path"), "l_shipdate").join(importer, "l_orderkey")
    return lines.groupBy("path").agg(
        F.count_distinct(F.when(F.col("now") != F.col("path"), F.col("now"))).alias("fan_in_now"),
        F.count_distinct(F.when(old & (F.col("then") != F.col("path")), F.col("then"))).alias("fan_in_then"),
        F.count_distinct(F.when(F.col("l_shipdate") < cut(TOUCH_CUT), F.col("l_orderkey"))).alias("touches_now"),
        F.count_distinct(F.when(old, F.col("l_orderkey"))).alias("touches_then"),
        F.min("l_shipdate").alias("first_seen"))


def part_module_path(t: Column, pk: Column, size: Column) -> Column:
    """Source path of a part as a module: ``src/<type>/<key>.ts``, ``.tsx``
    for sizes above 30, or a directory ``src/<type>/<key>/index.ts`` above 40."""
    stem = F.concat(F.lit("src/"), F.lower(t), F.lit("/"), pk.cast("string"))
    return (F.when(size > 40, F.concat(stem, F.lit("/index.ts")))
            .when(size > 30, F.concat(stem, F.lit(".tsx")))
            .otherwise(F.concat(stem, F.lit(".ts"))))


def part_module_files(part: DataFrame) -> DataFrame:
    """``repo, path`` (a source path string) per part."""
    return part.select(F.lit("parts").alias("repo"),
                       part_module_path(F.col("p_type"), F.col("p_partkey"), F.col("p_size"))
                       .alias("path"), F.col("p_partkey").alias("part_key"))


def first_line_import_decls(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Import declarations written by each order's first-line part: one per
    line of the order, as the specifier text a developer would write.

    The specifier is relative to the importer's directory (``./x`` within a
    type, ``../type/x`` across, one more ``../`` from a directory index);
    line 2 uses the ``.js`` spelling for file targets, lines 3 to 5 a ``/``,
    ``/.`` or ``/x/..`` behind directory targets, line 6 names a file that
    does not exist and line 7 a bare package — neither resolves.
    """
    importer = lineitem.groupBy("l_orderkey").agg(_part_at(F.min(line_position())).alias("imp"))
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(
        importer, "l_orderkey")
    pi = part.select(F.col("p_partkey").alias("imp"), F.lower("p_type").alias("it"),
                     F.col("p_size").alias("isz"))
    pt = part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("tt"),
                     F.col("p_size").alias("tsz"))
    x = lines.join(pi, "imp").join(pt, "l_partkey")
    up = F.when(F.col("isz") > 40, F.lit("../")).otherwise(F.lit("./"))
    same = F.col("it") == F.col("tt")
    rel = F.when(same, F.concat(up, F.col("l_partkey").cast("string"))).otherwise(
        F.concat(F.when(F.col("isz") > 40, F.lit("../../")).otherwise(F.lit("../")),
                 F.col("tt"), F.lit("/"), F.col("l_partkey").cast("string")))
    spec = (F.when(F.col("l_linenumber") == 7, F.concat(F.lit("pkg-"), F.col("l_partkey").cast("string")))
            .when(F.col("l_linenumber") == 6, F.concat(F.lit("./missing-"), F.col("l_partkey").cast("string")))
            .when((F.col("l_linenumber") == 2) & (F.col("tsz") <= 40), F.concat(rel, F.lit(".js")))
            .when((F.col("l_linenumber") == 3) & (F.col("tsz") > 40), F.concat(rel, F.lit("/")))
            .when((F.col("l_linenumber") == 4) & (F.col("tsz") > 40), F.concat(rel, F.lit("/.")))
            .when((F.col("l_linenumber") == 5) & (F.col("tsz") > 40), F.concat(rel, F.lit("/x/..")))
            .otherwise(rel))
    return x.select(F.lit("parts").alias("repo"),
                    part_module_path(F.col("it"), F.col("imp"), F.col("isz")).alias("src_path"),
                    F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("decl_pos"),
                    spec.alias("spec"))


# A TypeScript file per part, as text: the same SQL writes it in Spark and in
# the oracle, which counts from the columns what the metrics find in the text.
SOURCE_SUFFIX_SQL = "CASE WHEN {0} % 3 = 0 THEN '.tsx' ELSE '.ts' END"
SOURCE_PATH_SQL = ("CASE WHEN p_partkey = 0 THEN 'C:/w/src/index.ts' ELSE 'C:/w/src/m' || CAST(p_partkey AS VARCHAR(20)) || "
                   + SOURCE_SUFFIX_SQL.format("p_partkey") + " END")
SOURCE_SQL = """
'import { ' || split_part(p_name, ' ', 1) || ' as x, ' || split_part(p_name, ' ', 2) || ' } from "./m'
|| CAST(p_partkey - p_size AS VARCHAR(20)) || '";' || chr(10)
|| '/* import { no } from "./m2"; if (a) */' || chr(10)
|| 'const re = /["' || chr(39) || ']/g, q = a / b / c;' || chr(10)
|| 'const t = `import { y } from "./m1"; ${z ? 1 : 2} case`;' || chr(10)
|| 'export const ' || split_part(p_name, ' ', 1) || CAST(p_partkey AS VARCHAR(20)) || ' = f("if (x) && y", 1), '
|| split_part(p_name, ' ', 2) || CAST(p_partkey AS VARCHAR(20)) || ': Map<string, number> = new Map();' || chr(10)
|| repeat('if (a > 1) { b(); }' || chr(10), p_size % 7)
|| CASE p_type WHEN 'SMALL' THEN 'switch (a) { case "x": break; case C.D: break; }' || chr(10)
     WHEN 'LARGE' THEN 'const o = { case: 1 }, v = a ? b : c ?? d;' || chr(10)
     WHEN 'MEDIUM' THEN 'const c = css`${p => p.on ? `a{${ c }` : ""}`;' || chr(10)
     WHEN 'STANDARD' THEN 'if (a) /[' || chr(39) || '"]/.test(b);' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 3 = 0 AND p_partkey <> 0 THEN 'const p = <p title="it' || chr(39) || 's">Don' || chr(39) || 't stop? see http://x.y/z {a && <b>rock ' || chr(39) || 'n roll</b>}</p>;' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 6 = 1 THEN 'export interface I1 { m?(): void; n?<T>(x: T): void }' || chr(10) || 'type C1<T> = T extends (infer U)[] ? U : never;' || chr(10)
     || 'function g(a? : string) {}' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 7 = 3 THEN 'namespace N { export const hid = 1; export function hid2() {} }' || chr(10) || 'declare module "q" { export function hid3(): void }' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 11 = 4 THEN 'class P { if(x) { return x ?? 1; } catch(f) {} }' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 13 = 5 THEN 'export const { a: { b1, c1 = [1, 2] }, ...d1 } = e;' || chr(10) || 'export import A1 = B.C;' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 4 IN (1, 2) THEN 'export * from ' || chr(39) || './m' || CAST(p_partkey - 1 AS VARCHAR(20)) || '.js' || chr(39) || ';' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 5 = 0 THEN 'import ".";' || chr(10) ELSE '' END
|| CASE WHEN p_type = 'PROMO' AND p_size >= 45 THEN 'export const broken = (' ELSE '' END
"""


def part_sources(part: DataFrame) -> DataFrame:
    """``repo, path, rel_path, content``: a source file per part."""
    spark = part.sparkSession
    # A count of its own keeps adaptive execution from making one task of narrow rows with much work.
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = part.select("p_partkey", "p_name", "p_type", "p_size").repartition(wide, "p_partkey")
    path = F.expr(SOURCE_PATH_SQL)
    return narrow.select(F.lit("parts").alias("repo"), path.alias("path"), F.regexp_replace(path, "^C:/w/", "").alias("rel_path"),
                         F.expr(SOURCE_SQL).alias("content"))
