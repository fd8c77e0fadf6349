"""Source-tree scan (S1): every ``*.ts``/``*.tsx`` under a root, as
``repo, path, rel_path, content`` rows, with the ignore rules (F1) applied to
the root-relative path.

Spark's own file listing skips every name that starts with ``_`` or ``.``
(``_app.tsx``, ``__tests__/``, ``.storybook/``), so the tree is listed and read in
tasks through Arrow's file systems (local, HDFS, S3, GCS …): tasks
list the root, then its directories, then walk what is below those, dealt out
anew each time, and the files found are dealt out again to be read. Only F1 leaves files out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from faultline.operators.filters import IGNORED_DIRS, path_rules

EXTENSIONS = (".ts", ".tsx")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: What Hadoop calls a store that Arrow knows by another scheme.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(uri: str) -> str:
    """A Hadoop URI as Arrow's file systems spell it."""
    scheme, colon, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{colon}{rest}"


def _root(spark: SparkSession, root: str) -> tuple[str, str]:
    """The root as a URI, and its path without the scheme; raises unless it is a directory."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        raise FileNotFoundError(f"Path does not exist: {root}")
    if not store.getFileStatus(p).isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {root}")
    uri = store.makeQualified(p).toUri()
    return (f"file://{uri.getPath()}" if uri.getScheme() == "file" else arrow_uri(uri.toString())), uri.getPath().rstrip("/")


def _lister(uri: str, deep: bool, pruned: frozenset[str], endings: tuple[str, ...]) -> Callable:
    """Lists directories given by their path under the root: their files with one
    of the endings and directories, or with ``deep`` all such files below; files
    pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _opened(uri)
        for batch in batches:
            todo = list(zip(batch.column("rel").to_pylist(), batch.column("dir").to_pylist()))
            found = []
            while todo:
                rel, is_dir = todo.pop()
                if not is_dir:
                    found.append((rel, False))
                    continue
                below = []
                for info in store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{rel}".rstrip("/"))):
                    own = f"{rel}/{info.base_name}".lstrip("/")
                    if info.type == fs.FileType.Directory and info.base_name not in pruned:
                        below.append((own, True))
                    elif info.type == fs.FileType.File and own.endswith(endings):
                        below.append((own, False))
                (todo if deep else found).extend(below)
                if len(found) > 10_000:
                    yield _names(found)
                    found = []
            yield _names(found)

    return run


def _names(found: list[tuple[str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], ["rel", "dir"])


def _reader(uri: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(uri)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                with store.open_input_stream(f"{base.rstrip('/')}/{row.column('under')[0].as_py()}") as file:
                    text = file.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([row.column("repo"), row.column("path"), row.column("rel_path"), pa.array([text], pa.string())],
                                                 ["repo", "path", "rel_path", "content"])

    return run


def _by_value(fn: Callable) -> Callable:
    """Functions of this module travel by value: executors need not have the package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return fn


def listed_files(spark: SparkSession, root: str, pruned: frozenset[str] = frozenset(),
                 endings: tuple[str, ...] = ("",)) -> tuple[DataFrame, str, str]:
    """``rel`` of all files below the root that have one of the endings; the root
    as URI and path."""
    uri, top = _root(spark, root)
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.createDataFrame([("", True)], "rel string, dir boolean")
    for deep in (False, False, True):
        listed = listed.mapInArrow(_by_value(_lister(uri, deep, pruned, endings)), "rel string, dir boolean").repartition(wide, "rel")
    return listed.select("rel"), uri, top


def _files(spark: SparkSession, root: str, exclude) -> tuple[DataFrame, str, str]:
    # Directories that the default rules exclude at any depth aren't entered.
    return listed_files(spark, root, frozenset(IGNORED_DIRS if exclude is None else ()), EXTENSIONS)


def _read(files: DataFrame, uri: str, include, exclude) -> DataFrame:
    """Content of ``repo, path, rel_path, under`` rows that the path rules keep."""
    kept = path_rules(files, "rel_path", include, exclude)
    return kept.mapInArrow(_by_value(_reader(uri)), "repo string, path string, rel_path string, content string")


def read_source_tree(spark: SparkSession, root: str, repo: str | None = None,
                     include=None, exclude=None) -> DataFrame:
    """Whole-text rows of the TypeScript files under ``root``.

    A missing root raises "does not exist"; a file raises "not a directory";
    an empty directory gives 0 rows. ``path`` is the file's full path without
    the URI scheme; ``rel_path`` is relative to the root and is what the ignore
    rules see. One row per file.
    """
    files, uri, top = _files(spark, root, exclude)
    rows = files.select(F.lit(repo or root).alias("repo"), F.concat(F.lit(top + "/"), F.col("rel")).alias("path"),
                        F.col("rel").alias("rel_path"), F.col("rel").alias("under"))
    return _read(rows, uri, include, exclude)


def read_source_forest(spark: SparkSession, base: str, include=None,
                       exclude=None) -> DataFrame:
    """Many repositories at once: every top-level directory under ``base`` is
    one repository (its name is ``repo``). One listing and one read for all of
    them; ``rel_path`` is relative to the repository's directory and is what
    the ignore rules see. Files directly under ``base`` belong to no repository."""
    files, uri, top = _files(spark, base, exclude)
    rows = files.filter(F.col("rel").contains("/")).select(
        F.regexp_extract("rel", "^([^/]+)/", 1).alias("repo"), F.concat(F.lit(top + "/"), F.col("rel")).alias("path"),
        F.regexp_replace("rel", "^[^/]+/", "").alias("rel_path"), F.col("rel").alias("under"))
    return _read(rows, uri, include, exclude)


def read_contents(spark: SparkSession, root: str, files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the ``content`` of each: only the files of these rows are
    opened. ``path`` is as :func:`read_source_tree` gives it, under ``root``; content is
    null for a file that is gone."""
    uri, top = _root(spark, root)
    schema = T.StructType([f for f in files.schema.fields if f.name != "content"] + [T.StructField("content", T.StringType())])
    own = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(uri)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    with store.open_input_stream(base.rstrip("/") + row.column(path)[0].as_py()[len(top):]) as file:
                        text = file.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    text = None
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in own), pa.array([text], pa.string())], schema.names)

    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select(*own).repartition(wide, path).mapInArrow(_by_value(run), schema)


def write_source_tree(files: DataFrame, root: str, rel_path: str = "rel_path", content: str = "content") -> None:
    """Writes each row's content to its file under ``root``, in tasks."""
    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(p)
    uri, _ = _root(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _opened(uri)
        made, n = set(), 0
        for batch in batches:
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{base.rstrip('/')}/{rel}"
                folder = at.rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                with target.open_output_stream(at) as file:
                    file.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select(F.col(rel_path), F.col(content)).mapInArrow(_by_value(run), "n long").agg(F.sum("n")).collect()


def read_source_table(spark: SparkSession, table_or_path: str, fmt: str = "parquet") -> DataFrame:
    """An existing ``source_files(repo, path, content)`` table or dataset."""
    if "/" in table_or_path:
        return spark.read.format(fmt).load(table_or_path)
    return spark.table(table_or_path)
