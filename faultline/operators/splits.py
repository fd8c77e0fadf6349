"""Relational forms of the split checks over many answers at once:
duplicate symbols across split entries (A8) and symbol membership against the
file's exports and imports (J4 / X5).

Positions are carried as sortable values (best a number, whose minimum hashes)
instead of a dense row number, so no window over an answer (a possibly hot key)
is needed; lists are built from
``collect_list`` of (position, value) structs and sorted, because
``collect_list`` alone is unordered after a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators.validation import MSG_DUPLICATE, MSG_IMPORTED, MSG_NO_EXPORTS, MSG_UNVERIFIED


def split_duplicates(occ: DataFrame, keys=("answer",), entry: str = "entry",
                     symbol: str = "symbol", pos: str = "pos") -> DataFrame:
    """One row per symbol listed more than once over an answer's split entries
    (a repeat inside one entry counts): ``keys…, symbol, n, files, warning``.

    ``occ`` holds one row per (entry, symbol) occurrence with a sortable
    ``pos``; entries are ordered by their first position, occurrences within an
    entry by position — the order the split is written in.

    Duplicated (answer, symbol) keys are found first with a hash count (map-side
    combined); entry positions and ordered file lists are then computed only
    for the occurrences in those groups and the entries they touch.
    """
    keys = list(keys)
    o = occ.select(*keys, entry, symbol, pos)
    dup_keys = (o.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1))
    dup_occ = o.join(dup_keys, [*keys, symbol], "inner")
    touched = dup_occ.select(*keys, entry).distinct()
    first = (o.join(touched, [*keys, entry], "left_semi")
             .groupBy(*keys, entry).agg(F.min(pos).alias("_entry_pos")))
    dup = (dup_occ.join(first, [*keys, entry])
           .groupBy(*keys, symbol, "n")
           .agg(F.sort_array(F.collect_list(F.struct("_entry_pos", pos, F.col(entry).alias("e"))))
                .alias("_occ")))
    files = F.array_join(F.transform("_occ", lambda x: x["e"].cast("string")), ", ")
    return dup.select(*keys, symbol, "n", files.alias("files"),
                      F.format_string(MSG_DUPLICATE, F.col(symbol).cast("string"), files)
                      .alias("warning"))


def symbol_membership(moved: DataFrame, exports: DataFrame, imports: DataFrame,
                      keys=("answer",), symbol: str = "symbol", pos: str = "pos") -> DataFrame:
    """Classify moved symbols against a file's exports and imports.

    Returns one row per answer and warning kind: ``kind`` is ``imported`` or
    ``unverified`` (distinct symbols in first-seen order), or ``no_exports``
    for an answer whose file exports nothing.

    One aggregate over all three tables gives each (answer, symbol) its first
    moved position (a map-side combined ``min`` of numeric positions) and whether
    it is exported or imported; an answer's lists gather its distinct symbols
    only, which are the output.
    """
    keys = list(keys)
    none = F.lit(None).cast(moved.schema[pos].dataType)
    marked = moved.select(*keys, symbol, pos, F.lit(False).alias("_ex"), F.lit(False).alias("_im")).union(
        exports.select(*keys, symbol, none, F.lit(True), F.lit(False))).union(
        imports.select(*keys, symbol, none, F.lit(False), F.lit(True)))
    symbols = marked.groupBy(*keys, symbol).agg(F.min(pos).alias(pos), F.bool_or("_ex").alias("_ex"), F.bool_or("_im").alias("_im"))
    answers = symbols.groupBy(*keys).agg(F.bool_or("_ex").alias("_exports"), F.count(pos).alias("_moved")).filter("_moved > 0")
    foreign = (symbols.filter(F.col(pos).isNotNull() & ~F.col("_ex"))
               .join(answers.filter("_exports").select(*keys), keys, "left_semi")
               .withColumn("kind", F.when(F.col("_im"), "imported").otherwise("unverified")))
    grouped = foreign.groupBy(*keys, "kind").agg(
        F.sort_array(F.collect_list(F.struct(pos, F.col(symbol).cast("string").alias("s")))).alias("_l"))
    listed = grouped.select(*keys, "kind", F.transform("_l", lambda x: x["s"]).alias("_syms"))
    names = F.array_join("_syms", ", ")
    n = F.size("_syms").cast("long")
    text = F.when(F.col("kind") == "imported", F.format_string(MSG_IMPORTED, n, names)) \
        .otherwise(F.format_string(MSG_UNVERIFIED, n, names))
    warned = listed.select(*keys, "kind", n.alias("n"), names.alias("symbols"), text.alias("warning"))
    summary = (answers.filter("NOT _exports")
               .select(*keys, F.lit("no_exports").alias("kind"), F.lit(0).cast("long").alias("n"),
                       F.lit("").alias("symbols"), F.lit(MSG_NO_EXPORTS).alias("warning")))
    return warned.unionByName(summary)
