"""Commit-log source.

Reads plain ``git log --name-only --pretty=format:`` exports, one file per
repository (``<dir>/<repo>.log`` or ``<dir>/repo=<repo>/…``). Lines are
trimmed and blanks dropped; each remaining line is one commit listing one path,
so counting lines per path is the touch count.

The logs are a Spark data source of their own (``commit_log``), since Spark's
text reader skips files whose names start with ``_`` or ``.``. Its partitions
are byte ranges that begin and end at line ends, so a long history is spread
over many tasks; a compressed log is one range. Filters on ``repo`` choose the
files to read, filters on ``path`` drop lines in the reader.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from faultline.operators.history import history_path_filter
from faultline.sources.source_tree import _opened, _root

#: Bytes of a range, and of a read.
RANGE, READ = 64 << 20, 1 << 20
#: Files that writers leave beside the logs (fixed values).
_NO_LOG = re.compile(r"(^|/)(_SUCCESS|_committed_[^/]*|_started_[^/]*|[^/]*\.crc|_temporary/.*)$")
_PACKED = re.compile(r"\.(gz|bz2|zst|lz4)$")


def repo_of(file_path: str) -> str:
    """The repository a log is of: a ``repo=<repo>/`` directory, else the file's name."""
    part = re.search(r"(?:^|/)repo=([^/]+)/", file_path)
    return part[1] if part else re.search(r"([^/]+?)(\.[^./]*)?$", _PACKED.sub("", file_path))[1]


@dataclass
class LogRange(InputPartition):
    """Lines that start in bytes start to end of a log."""

    file: str
    repo: str
    start: int
    end: int


def _lines(store, part: LogRange) -> Iterator[list[bytes]]:
    """Lists of the range's lines. The line that a border cuts is the earlier range's."""
    if part.end < 0:
        with store.open_input_stream(part.file, compression="detect") as file:
            rest = b""
            while block := file.read(READ):
                *whole, rest = (rest + block).split(b"\n")
                yield whole
            yield [rest]
        return
    with store.open_input_file(part.file) as file:
        at, size = part.start, file.size()
        if at:
            # Skip to the first line that starts in the range: behind a line end at or after the byte before it.
            file.seek(at - 1)
            at -= 1
            while at < part.end:
                block = file.read(READ)
                found = block.find(b"\n")
                if found >= 0 or not block:
                    at += found + 1 if block else 0
                    break
                at += len(block)
            file.seek(at)
        rest = b""
        while at < min(part.end, size) or rest:
            block = file.read(READ)
            if not block:
                yield [rest]
                return
            lines = (rest + block).split(b"\n")
            begun = at - len(rest)  # where the first of them starts
            at += len(block)
            if at < part.end:
                rest = lines.pop()
                yield lines
                continue
            own = []
            for i, line in enumerate(lines):
                if begun >= part.end:
                    yield own
                    return
                if i == len(lines) - 1:
                    break
                own.append(line)
                begun += len(line) + 1
            yield own
            rest = lines[-1]


class CommitLogReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.range = options["uri"], int(options.get("range", RANGE))
        self.repos: set[str] | None = None
        self.tests: list = []

    def pushFilters(self, filters):
        """Repositories choose files; tests of paths run on lines. What isn't known stays with Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("repo",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = wanted if self.repos is None else self.repos & wanted
            elif column == ("path",) and isinstance(f, (EqualTo, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, base = _opened(self.uri)
        out = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            rel = info.path[len(base):].lstrip("/")
            if info.type != fs.FileType.File or _NO_LOG.search(rel):
                continue
            repo = repo_of(rel)
            if self.repos is not None and repo not in self.repos:
                continue
            if _PACKED.search(rel):
                out.append(LogRange(info.path, repo, 0, -1))
            else:
                out += [LogRange(info.path, repo, i, min(i + self.range, info.size)) for i in range(0, info.size, self.range)]
        return out or [LogRange("", "", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        kinds = {"EqualTo": lambda p, v: p == v, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": lambda p, v: v in p}
        tests = [(kinds[k], v) for k, v in self.tests]
        store, _ = _opened(self.uri)
        for lines in _lines(store, partition):
            paths = [p for x in lines if (p := x.decode("utf-8", "replace").strip()) and all(t(p, v) for t, v in tests)]
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array([partition.repo] * len(paths), pa.string()), pa.array(paths, pa.string())], ["repo", "path"])


class CommitLogSource(DataSource):
    """``spark.read.format("commit_log").option("uri", …)``."""

    @classmethod
    def name(cls):
        return "commit_log"

    def schema(self):
        return "repo string, path string"

    def reader(self, schema):
        return CommitLogReader(self.options)


def _registered(spark: SparkSession) -> None:
    """The source travels by value: executors need not have the package."""
    for module in (sys.modules[__name__], sys.modules[_opened.__module__]):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLogSource)


def read_commit_log(spark: SparkSession, path: str, git_root: DataFrame | None = None,
                    apply_filter: bool = True, split_bytes: int = RANGE) -> DataFrame:
    """``repo, path`` rows, one per (commit, listed file).

    ``git_root`` is a table ``repo, git_root`` of the absolute directory that
    each repository's log paths are relative to; with it, ``path`` is absolute
    (joined with ``/``), so it can be matched against scanned files even when
    the scan root is a subdirectory of the repository.
    """
    _registered(spark)
    uri, _ = _root(spark, path)
    lines = spark.read.format("commit_log").option("uri", uri).option("range", split_bytes).load()
    if apply_filter:
        lines = history_path_filter(lines)
    if git_root is not None:
        joined = lines.join(git_root.select("repo", "git_root"), "repo", "left")
        absolute = F.concat(F.regexp_replace("git_root", "/+$", ""), F.lit("/"), F.col("path"))
        lines = joined.select("repo", F.coalesce(absolute, F.col("path")).alias("path"))
    return lines


def history_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories whose log was exported — including empty logs (history
    exists, nothing touched). Files are listed, no log is read."""
    from pyarrow import fs

    uri, _ = _root(spark, path)
    store, base = _opened(uri)
    found = (info.path[len(base):].lstrip("/") for info in store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.File)
    repos = sorted({repo_of(rel) for rel in found if not _NO_LOG.search(rel)})
    return spark.createDataFrame([(r,) for r in repos], "repo string")
