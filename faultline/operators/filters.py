"""Include/exclude path rules of the source-tree scan (F1) and the
unparseable-file filter (F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Default scan rules (fixed values): TypeScript sources; skip these directories
# at any depth below the root, declaration files and type-test files. Regular
# *.test.ts files are kept.
INCLUDE = [r"\.(ts|tsx)$"]
IGNORED_DIRS = ["node_modules", ".git", "dist", "build", ".next", "coverage"]
IGNORED_SUFFIXES = [".d.ts", ".test-d.ts"]


def default_excludes() -> list[str]:
    dirs = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    return [rf"(^|/)({dirs})/"] + [s.replace(".", r"\.") + "$" for s in IGNORED_SUFFIXES]


def path_rules(df: DataFrame, rel_path: str = "rel_path", include=None,
               exclude=None) -> DataFrame:
    """Rows whose root-relative path matches every include rule and no exclude
    rule. Written as one filter so Catalyst can push it below content work."""
    include = INCLUDE if include is None else include
    exclude = default_excludes() if exclude is None else exclude
    cond = F.lit(True)
    for r in include:
        cond = cond & F.col(rel_path).rlike(r)
    for r in exclude:
        cond = cond & ~F.col(rel_path).rlike(r)
    return df.filter(cond)


def parseable(df: DataFrame) -> DataFrame:
    """Files without syntax errors."""
    return df.filter(~F.col("has_syntax_errors"))
