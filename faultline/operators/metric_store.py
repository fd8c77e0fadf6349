"""File metrics kept by content (S1, E1): a snapshot parses only what no earlier
snapshot has held.

A file's metrics depend on its content and on whether it may hold markup, so
they are stored under a fingerprint of both. A scan looks its files'
fingerprints up, parses each unseen content once, however many files hold it,
and appends those metrics; the files then get theirs by a join that moves no content.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.operators.metrics import file_metrics, markup_path
from faultline.session import stored

#: Bytes of rows that a task holds while it looks for equal contents.
HELD = 64 << 20
#: Changes of one content in one task from which they are measured apart from those of other tasks.
MANY = 64

MEASURES = ["lines", "complexity", "exported_symbols", "import_count", "imported_from", "imported_symbol_names", "has_syntax_errors", "star_exports"]
SCHEMA = ("fingerprint string, lines int, complexity int, exported_symbols array<string>, import_count int, imported_from array<string>, "
          "imported_symbol_names array<string>, has_syntax_errors boolean, star_exports array<string>")


def fingerprint(path: str = "path", content: str = "content") -> Column:
    """SHA-256 of the content, with the ending that decides how it is read."""
    return F.concat(F.sha2(F.coalesce(F.col(content), F.lit("")), 256), F.when(F.col(content).isNull(), "-").otherwise(""),
                    F.when(markup_path(path), ".tsx").otherwise(".ts"))


def known_metrics(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows, one per fingerprint (two writers may have appended the same content)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(store)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(store).dropDuplicates(["fingerprint"])


def measured_files(source_files: DataFrame, keys=("repo",), path: str = "path", content: str = "content",
                   store: str | None = None) -> DataFrame:
    """What :func:`faultline.operators.metrics.file_metrics` gives, each content
    parsed once and none that ``store`` (a folder that all executors share) knows.
    Without a store the contents of this call are told apart only."""
    spark = source_files.sparkSession
    own = [*keys, path] + [c for c in ("rel_path",) if c in source_files.columns and c != path]
    files = stored(source_files.select(*own, fingerprint(path, content).alias("fingerprint")), "fingerprints") if store else source_files.select(
        *own, fingerprint(path, content).alias("fingerprint"))
    texts = source_files.select(fingerprint(path, content).alias("fingerprint"), F.col(content).alias("content"))
    known = known_metrics(spark, store) if store else None
    if known is not None:
        unseen = files.select("fingerprint").distinct().join(known.select("fingerprint"), "fingerprint", "left_anti")
        texts = texts.join(unseen, "fingerprint", "left_semi")
    # A fingerprint has one content, so both are the key: a hash aggregate, where a first content per fingerprint would sort the texts.
    parsed = file_metrics(texts.distinct(), keys=(), path="fingerprint", content="content").select("fingerprint", *MEASURES)
    if known is not None:
        parsed = stored(parsed, "new-metrics")
        parsed.write.mode("append").parquet(store)
        parsed = parsed.union(known.select(*parsed.columns))
    return files.join(parsed, "fingerprint").select(*own, *MEASURES)


def _merged(batches):
    """The rows of Arrow batches (``content, markup, changes``) with those of equal content and markup made one."""
    import numpy as np
    import pyarrow as pa
    t = pa.Table.from_batches(batches).combine_chunks()
    content, markup, changes = (t[c].combine_chunks() for c in ("content", "markup", "changes"))
    code = content.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) * 2 + markup.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    lists = changes.take(pa.array(order))
    ends = lists.offsets.to_numpy()
    first = pa.array(order[starts])
    joined = pa.ListArray.from_arrays(pa.array(np.append(ends[starts], ends[-1])), lists.values, type=changes.type)
    return pa.RecordBatch.from_arrays([content.take(first), markup.take(first), joined], schema=t.schema)


def gathered(batches, held: int = HELD):
    """:func:`_merged` over a task's batches, of which about ``held`` bytes are kept at a time."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.nbytes
        if size > held:
            kept = [_merged(kept)]
            size = kept[0].nbytes
            if size > held // 2:
                yield kept.pop()
                size = 0
    if kept:
        yield _merged(kept)


def measured_changes(files: DataFrame, keys=("repo",), path: str = "path", content: str = "content") -> DataFrame:
    """:func:`measured_files` of a stream, whose contents can't be told apart by an aggregate or a join:
    each content of a micro-batch is parsed once.

    Rows of equal content are gathered, first in the task that has them, then in one task for each
    content; one that a task has often stays in a row of its own, so that no task gets all its
    changes. No state is kept, every row comes out, and event time stays event time.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = files.select(F.col(content).alias("content"), markup_path(path).alias("markup"), F.array(F.struct(*keys, path)).alias("changes"))
    often = F.when(F.size("changes") >= MANY, F.xxhash64("changes")).otherwise(F.lit(0).cast("long"))
    near = rows.mapInArrow(gathered, rows.schema)
    once = near.repartition("content", "markup", often).mapInArrow(gathered, rows.schema)
    ending = F.when(F.col("markup"), ".tsx").otherwise(".ts")
    parsed = file_metrics(once.select("changes", ending.alias("ending"), "content"), keys=("changes",), path="ending")
    return parsed.select(F.inline("changes"), *MEASURES)
