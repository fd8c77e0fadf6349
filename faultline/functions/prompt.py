"""Analysis prompt column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Source cap, truncation note, touch-count wording, layout.
MAX_SOURCE_CHARS = 24000
TRUNCATION_NOTE = ("\n\n[TRUNCATED — file continues beyond this point. Base your analysis on "
                   "what's shown; note in driftSummary that this was a partial read if it matters.]")
TOUCH_KNOWN = "Git touch count: %d commit(s) have modified this file"
TOUCH_UNKNOWN = "Git touch count: unavailable (no git history for this repo)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def build_prompt(path, exported_symbols, source, touch_count,
                 max_chars: int = MAX_SOURCE_CHARS) -> Column:
    """The per-file user prompt: path, exports as a JSON array, the touch
    line, and the source cut at ``max_chars`` characters with a note.

    Lengths are in code points (JavaScript counts UTF-16 units; a file with
    astral characters is cut a little later here)."""
    src = _c(source)
    long = F.length(src) > max_chars
    body = F.when(long, F.concat(F.substring(src, 1, max_chars), F.lit(TRUNCATION_NOTE))).otherwise(src)
    touch = F.when(_c(touch_count).isNotNull(),
                   F.format_string(TOUCH_KNOWN, _c(touch_count))).otherwise(F.lit(TOUCH_UNKNOWN))
    return F.concat(F.lit("File path: "), _c(path).cast("string"),
                    F.lit("\nExported symbols: "), F.to_json(_c(exported_symbols)),
                    F.lit("\n"), touch, F.lit("\n\nSource:\n```typescript\n"), body, F.lit("\n```"))
