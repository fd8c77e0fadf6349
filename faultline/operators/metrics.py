"""Per-file metrics (P1-P5) and the repository scan (S1 -> F1 -> P1..P5 -> J1 -> A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as tx, tokens as tk
from faultline.operators.graph import fan_in, resolve_import_rows
from faultline.session import stored


def markup_path(path: str = "path") -> Column:
    """May a file hold markup?"""
    return F.lower(F.col(path).cast("string")).endswith(".tsx")


def file_metrics(source_files: DataFrame, keys=("repo",), path: str = "path",
                 content: str = "content") -> DataFrame:
    """``keys…, path, [rel_path,] lines, complexity, exported_symbols, import_count,
    imported_from, imported_symbol_names, has_syntax_errors, star_exports``.

    One scan of the tokens reads each file (markup where its path ends in
    ``.tsx``); every metric starts from the code and the module text that it
    leaves, and the raw content is dropped after. A ``rel_path`` column is carried along.
    """
    own = [*keys, path] + [c for c in ("rel_path",) if c in source_files.columns and c != path]
    markup = markup_path(path)
    read = source_files.select(*own, tx.line_count(content).alias("lines"), markup.alias("_markup"), tk.source_tokens(content).alias("_tokens")).select(
        *own, "lines", "_tokens", tk.once(tk.modes_column).alias("_read")).select(
        *own, "lines", F.col("_read.broken").alias("has_syntax_errors"),
        tk.code_text(F.col("_tokens"), F.col("_read.letters")).alias("_code"),
        tk.module_text(F.col("_tokens"), F.col("_read.letters")).alias("_module"))
    staged = read.select(
        *own, "lines", "has_syntax_errors", tx.decision_points("_code").alias("complexity"),
        tx.exported_symbols("_module").alias("exported_symbols"), tx.module_declarations("_module").alias("_declarations"))
    imports = tx.import_declarations("_declarations")
    return staged.select(
        *own, "lines", "complexity", "exported_symbols",
        F.size(imports).alias("import_count"),
        tx.import_specifiers(imports).alias("imported_from"),
        tx.imported_symbol_names(imports).alias("imported_symbol_names"),
        "has_syntax_errors", tx.star_export_specifiers("_declarations").alias("star_exports"))


def star_edges(metrics: DataFrame, keys=("repo",), path: str = "path") -> DataFrame:
    """``(keys…, src_path, dst_path)`` of ``export * from "…"`` declarations."""
    decls = metrics.filter(F.size("star_exports") > 0).select(
        *keys, F.col(path).alias("src_path"), F.posexplode("star_exports").alias("decl_pos", "spec"))
    return resolve_import_rows(decls, metrics, keys, path)


def star_closure(metrics: DataFrame, keys=("repo",), path: str = "path", edges: DataFrame | None = None) -> DataFrame:
    """``(keys…, path, symbol)``: the names that each file re-exports through
    ``export * from "…"`` (never ``default``), over chains of any length.

    Reachable pairs of files double their distance each round (new pairs met with
    all pairs on either side), so a chain of n files takes about log2 n rounds,
    each of one aggregate into one stored table. Files that reach each other are
    one from then on (the least of them), so a cycle doesn't make pairs of all
    its files. Names join the pairs once, at the end.
    """
    keys = list(keys)
    start = star_edges(metrics, keys, path) if edges is None else edges
    reach = stored(start.select(*keys, F.col("src_path").alias("a"), F.col("dst_path").alias("b"), F.lit(0).alias("round")), "star-pairs")
    # The file that stands for each; only those that were in a cycle have a row.
    standing = reach.limit(0).select(*keys, F.col("a").alias(path), F.col("b").alias("stands"))
    n = 0
    while not reach.filter(F.col("round") == n).isEmpty():
        n += 1
        new = reach.filter(F.col("round") == n - 1)
        forth = new.select(*keys, "a", F.col("b").alias("m")).join(reach.select(*keys, F.col("a").alias("m"), "b"), [*keys, "m"])
        back = reach.select(*keys, "a", F.col("b").alias("m")).join(new.select(*keys, F.col("a").alias("m"), "b"), [*keys, "m"])
        met = forth.union(back).select(*keys, "a", "b", F.lit(n).alias("round"))
        reach = stored(reach.union(met).groupBy(*keys, "a", "b").agg(F.min("round").alias("round")), "star-pairs")
        loops = reach.groupBy(*keys, F.greatest("a", "b").alias(path), F.least("a", "b").alias("low")).agg(
            F.count_if(F.col("a") <= F.col("b")).alias("up"), F.count_if(F.col("a") >= F.col("b")).alias("down")).filter(
            (F.col("up") > 0) & (F.col("down") > 0) & (F.col(path) != F.col("low")))
        merged = stored(loops.groupBy(*keys, path).agg(F.min("low").alias("into")), "star-loops")
        if merged.isEmpty():
            continue
        # All pairs count as new: a merged cycle brings its files' neighbours nearer.
        ends = reach.select(*keys, "a", "b")
        for end in ("a", "b"):
            ends = ends.join(merged.select(*keys, F.col(path).alias(end), F.col("into").alias("_into")), [*keys, end], "left").withColumn(
                end, F.coalesce("_into", end)).drop("_into")
        reach = stored(ends.filter(F.col("a") != F.col("b")).select(*keys, "a", "b").distinct().withColumn("round", F.lit(n)), "star-pairs")
        moved = standing.join(merged.select(*keys, F.col(path).alias("stands"), "into"), [*keys, "stands"], "left").select(
            *keys, path, F.coalesce("into", "stands").alias("stands"))
        fresh = merged.join(standing.select(*keys, path), [*keys, path], "left_anti").select(*keys, path, F.col("into").alias("stands"))
        standing = stored(moved.union(fresh), "star-standing")
    names = metrics.select(*keys, F.col(path).cast("string").alias(path), F.explode("exported_symbols").alias("symbol")).filter("symbol <> 'default'")
    held = names.join(standing, [*keys, path], "left").select(*keys, F.coalesce("stands", path).alias("b"), "symbol").distinct()
    # A file of a cycle also gets the names of the file that stands for it.
    looped = standing.select(*keys, F.col("stands").alias("a")).distinct()
    pairs = reach.select(*keys, "a", "b").union(looped.select(*keys, "a", F.col("a").alias("b")))
    given = pairs.join(held, [*keys, "b"]).select(*keys, "a", "symbol").distinct()
    alone = given.select(*keys, F.col("a").alias(path), "symbol")
    members = standing.withColumnRenamed("stands", "a").join(given, [*keys, "a"]).select(*keys, path, "symbol")
    return alone.union(members)


def follow_star_exports(metrics: DataFrame, keys=("repo",), path: str = "path", edges: DataFrame | None = None) -> DataFrame:
    """``metrics`` with the names of :func:`star_closure` added to
    ``exported_symbols``: the file's own first, the re-exported ones sorted."""
    keys = list(keys)
    added = star_closure(metrics, keys, path, edges).groupBy(*keys, path).agg(F.array_sort(F.collect_set("symbol")).alias("_more"))
    joined = metrics.join(added, [*keys, path], "left")
    return joined.withColumn("exported_symbols", F.array_distinct(F.concat(
        "exported_symbols", F.coalesce("_more", F.array().cast("array<string>"))))).select(*metrics.columns)


def scan(source_files: DataFrame, keys=("repo",), path: str = "path",
         content: str = "content", store: str | None = None) -> DataFrame:
    """File metrics plus ``fan_in`` over resolved import edges.

    The sources are read once: their metrics, which hold no content, are a
    stored table that edges, closure and fan-in start from. With ``store``, a folder of
    metrics by content, only contents that no earlier scan has put there are parsed.
    """
    if store:
        from faultline.operators.metric_store import measured_files
        m = stored(measured_files(source_files, keys, path, content, store), "file-metrics")
    else:
        m = stored(file_metrics(source_files, keys, path, content), "file-metrics")
    return scan_metrics(m, keys, path)


def scan_metrics(m: DataFrame, keys=("repo",), path: str = "path") -> DataFrame:
    """:func:`scan` from stored file metrics. Imports and star exports are resolved by one
    join against one index of the files' keys; the edges are a stored table."""
    keys = list(keys)
    spelled = [m.select(*keys, F.col(path).alias("src_path"), F.explode(specs).alias("spec"), F.lit(star).alias("star"))
               for specs, star in (("imported_from", False), ("star_exports", True))]
    edges = stored(resolve_import_rows(spelled[0].union(spelled[1]), m, keys, path, carry=("star",)), "edges")
    pairs = lambda star: edges.filter(F.col("star") == star).drop("star")
    return fan_in(follow_star_exports(m, keys, path, pairs(True)), pairs(False), keys=keys, path=path)
