"""Lexical source metrics for TypeScript text, as built-in column functions:
line count (P1), decision points (P2), exported symbols (P3), import
declarations (P4) and a syntax-integrity flag (P5).

There is no parser here. :mod:`faultline.functions.tokens` reads the text once
with a stack of modes; decision points are counted in the code that it leaves,
declarations are searched in what it leaves of the module's own level.

Known lexical deviations from an AST: a conditional type inside a generic
argument or parameter list may count as a ternary; type parameters in markup
files are told from tags by a comma, ``extends`` or one capital letter; names are
ASCII; an ambient module's own declarations are no exports.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline.functions.tokens import IDENT

# ---------------------------------------------------------------- fixed patterns
# Strings: possessive, unrolled loops (no stack growth on long literals).
# An apostrophe inside a word (JSX text) opens nothing.
SQ_STRING = r"(?<![\w$])'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
DQ_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
TEMPLATE = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*.*?\*/"
STRINGS = "|".join([SQ_STRING, DQ_STRING, TEMPLATE])
COMMENTS = "|".join([LINE_COMMENT, BLOCK_COMMENT])

# Decision points: if, for / for-in / for-of / for await, while (one per while
# and per do-while), case (not default), catch, &&, ||, ??, and the ternary ?.
# Not counted: ?. and the assignments &&= ||= ??=.
KEYWORD_GUARD = r"(?<![.\w$])"
DECISION_POINT = (
    KEYWORD_GUARD + r"(?:if\s*\(|for\s*(?:await\s*)?\(|while\s*\(|case(?![\w$])(?!\s*[:=,})])|catch\s*[({])"
    r"|&&(?!=)|\|\|(?!=)|\?\?(?!=)|(?<!\?)\?(?:(?![?.]|\s*[:,)=;\]>])|(?=\.\d))")

# What a line that doesn't continue a declaration starts with.
NEXT_STATEMENT = (r"(?:export|import|const|let|var|function|async|class|abstract|interface|type|enum|declare|namespace|if|for|while|do|switch|try|return|throw)"
                  r"(?![\w$])|\}")
EXPORT_STMT = (
    r"(?<![\w$.])export\s+(?:default\b"
    r"|(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?:function\b\s*\*?|class\b|const\s+enum\b|interface\b"
    r"|type\b(?!\s*[\{*])|enum\b|namespace\b|module\b|import\s+(?:type\s+)?(?=" + IDENT + r"\s*=))\s*" + IDENT +
    r"|(?:declare\s+)?(?:const|let|var)\b(?!\s+enum\b)[^;]*?(?=;|\n\s*(?:" + NEXT_STATEMENT + r")|\z)"
    r"|(?:type\s+)?\{[^}]*\}|\*\s*as\s+" + IDENT + ")")
# In the module text a declaration is a keyword, a clause and the module's name.
MODULE_NAME = r"(?:'[^'\n]*'|\"[^\"\n]*\")"
IMPORT_DECL = r"(?<![\w$.])import\b\s*(?:type\b\s*)?(?:[\w$*{][^;'\"=()]*?\bfrom\s*)?" + MODULE_NAME
STAR_EXPORT = r"(?<![\w$.])export\s+(?:type\s+)?\*\s*from\s*" + MODULE_NAME
DECLARATIONS = IMPORT_DECL + "|" + STAR_EXPORT.replace(r"export\s+", r"export\s*")
# Of an unterminated literal or comment; an apostrophe in a word is text.
LEFTOVER = r"(?<![\w$])'|[\"`]|/\*"
BRACKET_PAIRS = {")": "(", "]": "[", "}": "{"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_count(text) -> Column:
    """Number of ``\\n`` plus one (a file ending in a newline counts one more
    than ``wc -l``)."""
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("int")


def decision_points(masked, pattern: str = DECISION_POINT) -> Column:
    """1 + decision points, counted in one regex pass over masked text."""
    return (F.regexp_count(_c(masked), F.lit(pattern)) + 1).cast("int")


def _names_in_braces(s: Column) -> Column:
    items = F.transform(F.split(F.regexp_extract(s, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x))
    items = F.filter(items, lambda x: x != "")
    items = F.transform(items, lambda x: F.regexp_replace(x, r"^type\s+", ""))
    return items


def _bound_names(pattern: Column) -> Column:
    """Names that destructuring patterns bind, at any depth: what no colon follows,
    without defaults and computed keys."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\[[^\[\]]*\]\s*:", ":"), r"=[^,}\]]*", "")
    return F.regexp_extract_all(plain, F.lit(r"(" + IDENT + r")\s*(?=[,}\]])"), 1)


def _declared_names(m: Column) -> Column:
    """Names that ``export const …`` declares: what destructuring patterns bind,
    or each declarator."""
    rest = F.regexp_replace(m, r"^export\s+(?:declare\s+)?(?:const|let|var)\s*", "")
    pattern = F.regexp_extract(rest, r"(?s)^[{\[].*[}\]](?=\s*(?::[^=]*)?=(?![=>]))", 0)
    # The module text has nothing inside brackets; type arguments go from the innermost out.
    rounds = F.sequence(F.lit(1), F.regexp_count(rest, F.lit("<")) + 1)
    flat = F.aggregate(rounds, F.regexp_replace(rest, "=>", " "), lambda t, _: F.regexp_replace(t, r"<[^<>()\[\]{}=;]*>", " "))
    plain = F.transform(F.split(flat, ","), lambda x: F.regexp_extract(x, r"^\s*(" + IDENT + r")\s*!?\s*(?:[:=]|$)", 1))
    return F.when(rest.rlike(r"^[{\[]"), _bound_names(F.when(pattern == "", rest).otherwise(pattern))).otherwise(plain)


def exported_symbols(module) -> Column:
    """Distinct exported names in source order, of module text; a default export is ``default``;
    ``export {a as b}`` and re-export lists give ``b``."""
    stmts = F.regexp_extract_all(_c(module), F.lit(EXPORT_STMT), 0)

    def names(m: Column) -> Column:
        last_ident = F.array(F.regexp_extract(m, "(" + IDENT + r")$", 1))
        braces = F.transform(_names_in_braces(m), lambda x: F.when(
            x.rlike(r"\sas\s"), F.regexp_extract(x, r"\sas\s+(" + IDENT + ")$", 1)).otherwise(x))
        return (F.when(m.rlike(r"^export\s+default\b"), F.array(F.lit("default")))
                .when(m.rlike(r"^export\s+(?:declare\s+)?(?:const(?!\s+enum\b)|let|var)\b"), _declared_names(m))
                .when(m.rlike(r"^export\s+(?:type\s+)?\{"), braces)
                .otherwise(last_ident))

    return F.array_distinct(F.filter(F.flatten(F.transform(stmts, names)), lambda x: x != ""))


def module_declarations(module) -> Column:
    """Import and ``export * from`` declarations of module text."""
    return F.regexp_extract_all(_c(module), F.lit(DECLARATIONS), 0)


def import_declarations(declarations) -> Column:
    """Of :func:`module_declarations` the imports (not ``export … from``, not dynamic ``import()``)."""
    return F.filter(_c(declarations), lambda m: m.startswith("import"))


def star_export_specifiers(declarations) -> Column:
    """Specifiers of ``export * from "…"`` (not ``export * as ns``)."""
    found = F.filter(_c(declarations), lambda m: m.startswith("export"))
    return F.transform(found, lambda q: F.regexp_extract(q, r"['\"]([^'\"\n]*)['\"]$", 1))


def import_specifiers(decls) -> Column:
    """Module specifier of every declaration, in order, not de-duplicated."""
    return F.transform(_c(decls), lambda m: F.regexp_extract(m, r"['\"]([^'\"\n]*)['\"]$", 1))


def imported_symbol_names(decls) -> Column:
    """Per declaration: named imports (``a as b`` gives ``a``), then the default
    import, then the namespace import."""
    def symbols(m: Column) -> Column:
        clause = F.regexp_extract(m, r"(?s)^import\s*(?:type\s+)?(.*?)\s*\bfrom\s*['\"]", 1)
        named = F.when(clause.contains("{"), F.transform(
            _names_in_braces(clause), lambda x: F.regexp_extract(x, "^(" + IDENT + ")", 1))
        ).otherwise(F.array().cast("array<string>"))
        default = F.regexp_extract(clause, "^(" + IDENT + ")", 1)
        namespace = F.regexp_extract(clause, r"\*\s*as\s+(" + IDENT + ")", 1)
        return F.filter(F.concat(named, F.array(default), F.array(namespace)),
                        lambda x: x != "")
    return F.flatten(F.transform(_c(decls), symbols))


def brackets_balanced(masked) -> Column:
    """``()[]{}`` nest correctly — a stack kept as a string, folded over the
    bracket characters with ``aggregate``."""
    br = F.regexp_replace(_c(masked), r"[^()\[\]{}]", "")
    chars = F.filter(F.split(br, ""), lambda x: x != "")
    init = F.struct(F.lit("").alias("st"), F.lit(True).alias("ok"))

    def step(acc, ch):
        opener = (F.when(ch == ")", "(").when(ch == "]", "[").when(ch == "}", "{"))
        top = F.substring(acc["st"], -1, 1)
        pushed = F.struct(F.concat(acc["st"], ch).alias("st"), F.lit(True).alias("ok"))
        popped = F.struct(acc["st"].substr(F.lit(1), F.length(acc["st"]) - 1).alias("st"),
                          F.lit(True).alias("ok"))
        broken = F.struct(acc["st"].alias("st"), F.lit(False).alias("ok"))
        return (F.when(~acc["ok"], acc)
                .when(ch.isin("(", "[", "{"), pushed)
                .when((F.length(acc["st"]) > 0) & (top == opener), popped)
                .otherwise(broken))

    return F.aggregate(chars, init, step, lambda acc: acc["ok"] & (acc["st"] == ""))


def has_syntax_errors(masked, leftover: str = LEFTOVER) -> Column:
    """Lexical integrity of masked text of any kind: a quote,
    backtick or ``/*`` left after masking (an unterminated literal or comment),
    or unbalanced brackets."""
    m = _c(masked)
    return m.rlike(leftover) | ~brackets_balanced(m)
