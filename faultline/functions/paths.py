"""Path expressions: short path (P8), drive-path rewrite (P9), match key (P10),
repository-relative key (P11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_path(p, segments: int = 3) -> Column:
    """Last ``segments`` parts of a path split on either slash, joined by ``/``."""
    parts = F.split(_c(p), r"[\\/]")
    start = F.greatest(F.size(parts) - segments + 1, F.lit(1))
    return F.array_join(F.slice(parts, start, segments), "/")


def base_name(p) -> Column:
    """Last path segment (either slash)."""
    return short_path(p, 1)


def drive_path(p) -> Column:
    """``/c/x`` -> ``C:/x``: only a one-letter first segment followed by ``/``."""
    c = _c(p)
    m = r"^/([a-zA-Z])/(.*)$"
    return F.when(c.rlike(m), F.concat(F.upper(F.regexp_extract(c, m, 1)), F.lit(":/"),
                                       F.regexp_extract(c, "(?s)" + m, 2))).otherwise(c)


def path_key(p, case_insensitive) -> Column:
    """Match key: backslashes become ``/``; lower-cased on case-insensitive hosts.

    ``case_insensitive`` is a per-row (per-repository) flag, not the host OS of
    the machine running the job.
    """
    c = F.translate(_c(p), "\\", "/")
    ci = _c(case_insensitive) if not isinstance(case_insensitive, bool) else F.lit(case_insensitive)
    return F.when(ci, F.lower(c)).otherwise(c)


def relative_key(p, root) -> Column:
    """Path relative to ``root`` with forward slashes; a path not under the
    root stays whole. The prefix must end at a ``/`` boundary (``/repo2/x`` is
    not under ``/repo``)."""
    c = F.translate(_c(p), "\\", "/")
    r = F.regexp_replace(F.translate(_c(root), "\\", "/"), "/+$", "")
    under = c.startswith(F.concat(r, F.lit("/")))
    return F.when(under, c.substr(F.length(r) + 2, F.lit(1 << 30))).otherwise(c)
