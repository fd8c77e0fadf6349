"""Import graph: resolving import specifiers to files (J1) and fan-in (A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What a relative specifier may name, in the order the TypeScript "node" module
# resolution tries it (fixed values): the file with its extension, the file
# without one, then the directory by its index file.
FILE_SUFFIXES = [".ts", ".tsx", ".d.ts"]
INDEX_SUFFIXES = ["/index.ts", "/index.tsx", "/index.d.ts"]
JS_EXTENSION = r"\.(js|jsx|mjs|cjs)$"


def _fold_dots(p: Column) -> Column:
    """Collapse ``.`` / empty segments and ``..`` in a ``/``-separated path.

    Leading ``/`` is kept. ``..`` above the root is dropped, as path.resolve does.
    """
    segs = F.split(p, "/")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))))
    joined = F.array_join(folded, "/")
    return F.when(p.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def import_rows(files: DataFrame, keys=("repo",), path: str = "path",
                specs: str = "imported_from") -> DataFrame:
    """One row per import declaration: ``keys…, src_path, decl_pos, spec``."""
    return files.select(*keys, F.col(path).alias("src_path"),
                        F.posexplode(specs).alias("decl_pos", "spec"))


def parent_dir(p: Column) -> Column:
    """Directory of a path: everything before the last ``/`` ("" for none)."""
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def join_dir(d: Column, rel: Column) -> Column:
    """``d/rel``; just ``rel`` when ``d`` is empty (a relative root)."""
    return F.when(d == "", rel).otherwise(F.concat(d, F.lit("/"), rel))


#: A specifier that climbs first and names plain segments then; a directory that needs folding itself.
_PLAIN = r"^(?:\./)?(?:\.\./)*+(?!\.{0,2}(?:/|\z))[^/]++(?:/(?!\.{0,2}(?:/|\z))[^/]++)*+\z"
_CLIMB = r"^(?:\./)?(?:\.\./)*+"
_UNFOLDED = r"(?:^|/)\.{1,2}(?:/|\z)|//|/\z"


def spelled_path(src_dir: Column, spec: Column) -> Column:
    """``_fold_dots(join_dir(src_dir, spec))``. Most specifiers climb some directories
    and name plain segments: for those the directory is cut by its count of segments,
    only the others are folded segment by segment."""
    rest = F.regexp_replace(spec, _CLIMB, "")
    climbed = F.length(spec) - F.length(rest)
    ups = F.when(spec.startswith("./"), climbed - 2).otherwise(climbed) / 3
    segments = F.length(src_dir) - F.length(F.replace(src_dir, F.lit("/"), F.lit(""))) + 1
    kept = F.call_function("substring_index", src_dir, F.lit("/"), (segments - ups).cast("int"))
    plain = spec.rlike(_PLAIN) & (src_dir != "") & ~src_dir.rlike(_UNFOLDED) & (ups < segments)
    return F.when(plain, F.concat(kept, F.lit("/"), rest)).otherwise(_fold_dots(join_dir(src_dir, spec)))


def import_targets(files: DataFrame, keys=("repo",), path: str = "path") -> DataFrame:
    """``(keys…, key, to_any, to_file, to_dir)``: what each path that an import may
    spell resolves to: by all of the order, as a file only, as a directory only.

    A file has a handful of keys (its path, the path without a suffix, its
    directory if it is an index), so this table grows with the files, not with
    their imports.
    """
    keys = list(keys)
    p = F.col(path).cast("string")
    ways = [F.struct(p.alias("key"), F.lit(0).alias("rank"))]
    for i, suffix in enumerate([*FILE_SUFFIXES, *INDEX_SUFFIXES], 1):
        cut = F.expr(f"length(`{path}`) - {len(suffix)}")
        stem = F.when(p.endswith(suffix), p.substr(F.lit(1), cut))
        if suffix in INDEX_SUFFIXES:  # an index at the root is its directory, ""
            stem = F.when(p == suffix[1:], F.lit("")).otherwise(stem)
        ways.append(F.when(stem.isNotNull(), F.struct(stem.alias("key"), F.lit(i).alias("rank"))))
    n = len(FILE_SUFFIXES)
    spelled = files.select(*keys, p.alias("to"), F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("w")).select(
        *keys, "to", "w.key", "w.rank")
    return spelled.groupBy(*keys, "key").agg(
        F.min(F.struct("rank", "to"))["to"].alias("to_any"),
        F.min(F.when(F.col("rank").between(1, n), F.struct("rank", "to")))["to"].alias("to_file"),
        F.min(F.when(F.col("rank") > n, F.struct("rank", "to")))["to"].alias("to_dir"))


def resolve_import_rows(decls: DataFrame, files: DataFrame, keys=("repo",),
                        path: str = "path", carry=()) -> DataFrame:
    """Import edges ``(keys…, src_path, dst_path)`` from declaration rows
    ``(keys…, src_path, decl_pos, spec)``; ``carry`` names further columns that edges keep apart.

    Only relative specifiers (``.``, ``..``, ``./…``, ``../…``) resolve; bare
    package names and path aliases do not (no tsconfig is read). A specifier
    ending in ``.js`` names the sibling TypeScript file, not a directory; one
    that ends in ``/``, ``.`` or ``..`` names a directory only. Each declaration
    is one row of one join with :func:`import_targets`. Self imports are dropped
    and edges are de-duplicated per importer.
    """
    keys = list(keys)
    decl = decls.filter(F.col("spec").rlike(r"^\.{1,2}(/|$)") & F.col("src_path").isNotNull())
    src_dir = parent_dir(F.col("src_path").cast("string"))
    folded = decl.select(*keys, "src_path", *carry, spelled_path(src_dir, F.col("spec")).alias("_base"),
                         F.col("spec").rlike(r"(^|/)\.{0,2}$").alias("_dir"))
    is_js = F.col("_base").rlike(JS_EXTENSION) & ~F.col("_dir")
    key = F.when(is_js, F.regexp_replace("_base", JS_EXTENSION, "")).otherwise(F.col("_base"))
    # Never null, and seen to be: the join's own check for nulls, pushed down, would fold each path several times more.
    spelled = folded.select(*keys, "src_path", *carry, "_dir", is_js.alias("_js"), F.coalesce(key, F.lit("")).alias("key"))
    hits = spelled.join(import_targets(files, keys, path), [*keys, "key"])
    to = F.when(F.col("_dir"), F.col("to_dir")).when(F.col("_js"), F.col("to_file")).otherwise(F.col("to_any"))
    return (hits.select(*keys, "src_path", to.alias("dst_path"), *carry)
            .filter(F.col("dst_path").isNotNull() & (F.col("dst_path") != F.col("src_path").cast("string"))).distinct())


def resolve_imports(files: DataFrame, keys=("repo",), path: str = "path",
                    specs: str = "imported_from") -> DataFrame:
    """Import edges of scanned files (J1): ``import_rows`` then
    ``resolve_import_rows`` against the same files."""
    return resolve_import_rows(import_rows(files, keys, path, specs), files, keys, path)


def fan_in(files: DataFrame, edges: DataFrame, keys=("repo",), path: str = "path",
           src: str = "src_path", dst: str = "dst_path",
           drop_self: bool = True) -> DataFrame:
    """``files`` plus ``fan_in``: distinct importers per file, zero-filled.

    Two-phase aggregation (distinct (dst, src) pairs, then a count with
    map-side partial aggregation) keeps a hot target from landing in one task
    as raw rows; the join back to ``files`` is 1:1 on the key.
    """
    keys = list(keys)
    counts = fan_in_counts(edges, keys, src, dst, drop_self).withColumnRenamed(dst, path)
    return (files.join(counts, [*keys, path], "left")
            .withColumn("fan_in", F.coalesce(F.col("fan_in"), F.lit(0).cast("long"))))


def fan_in_counts(edges: DataFrame, keys=("repo",), src: str = "src_path",
                  dst: str = "dst_path", drop_self: bool = True) -> DataFrame:
    """``(keys…, dst, fan_in)`` for every target that has an importer."""
    keys = list(keys)
    e = edges.select(*keys, F.col(src).alias("_src"), F.col(dst).alias(dst))
    if drop_self:
        e = e.filter(F.col("_src") != F.col(dst))
    return e.groupBy(*keys, dst).agg(F.count_distinct("_src").alias("fan_in"))
