"""A pushdown scan of TypeScript source (the lexical part of P2, P3 and P5), as
built-in column functions.

One regular expression cuts the text into tokens: a stretch that can't change
how text is read, and the atom behind it (a quote, a bracket, ``${``, ``//``, a
line end …). One ``aggregate`` over them keeps a stack of modes and writes one
letter per token: how it is read. From tokens and letters two texts follow:
the *code* (no literal, comment or markup text, but what stands in ``${…}`` and in
markup's braces), and the *module text*, of which only what stands outside all
brackets is left, with the lists of imports and exports and module specifiers.

The stack holds one letter per level:

====================  =====================================================
``{``  ``M``          a block; members (class, interface, type or object)
``(``  ``i``  ``[``   parentheses; those of if, while, for; brackets
``e``  ``E``          braces and brackets of an import, export or pattern list
``$``  ``j``          ``${…}`` in a template; braces in markup
`````                 a template's text
``' "``  ``q Q``      strings; strings that name a module
``u U``               strings in a tag
``*``  ``l``          comments
``r``  ``R``          a regular expression; a class in it
``T A C J``           a tag, its type arguments, a closing tag, markup text
``x``  ``d``          behind ``extends``; between ``class`` and its members
====================  =====================================================

What no lexical rule can tell is decided by what stands before it: a slash
after an operand divides, a ``<`` after an operand compares, and braces after
``=``, ``(``, ``,`` or ``return`` hold members. A file that may hold markup has
to be marked as such (``.tsx``): elsewhere ``<T>x`` is a type assertion.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------- fixed patterns
IDENT = r"[A-Za-z_$][\w$]*"
_WORD_ATOM = r"(?<![.\w$])(?:extends(?![\w$])|(?:class|interface)(?![\w$])(?!\s*\())(?!\s*[:=?,;.})])"
# Tried only where no atom starts: plain characters, words, and the beginnings of
# two-letter atoms that aren't one here.
_STRETCH = r"(?:[^\\`'\"${}()\[\]<>/*=\n;,?\w]++|(?!" + _WORD_ATOM + r")(?:\w|\$(?!\{))++|=(?!>)|\*(?!/))*+"
_ATOM = (r"\\[\s\S]|\\|" + _WORD_ATOM + r"|[`'\"{}()\[\];,\n>]|\$\{|//|/\*|/>|/|\*/|=>"
         r"|</|<>|<[A-Z]>(?=\s*\()|<[A-Za-z_$][\w$]*(?:\s*,|\s+extends(?![\w$]))|<[A-Za-z_$]|<|\?\?=?|\?\.(?!\d)|\?")
TOKEN = "(" + _STRETCH + ")(" + _ATOM + r"|\z)"

_BEFORE = r"(?:^|[^.\w$])"
_NO_OPERAND = _BEFORE + r"(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield|default|extends|instanceof|as|satisfies)\s*$"
_OPERAND = r"[\w$)\]\u0080-\uFFFF](?:!|\+\+|--)?\s*$"
_CONTROL = _BEFORE + r"(?:if|while|with|for|for\s+await)\s*$"
_METHOD = _BEFORE + r"(?:if|while|with|for|catch)\s*$"
_MEMBERS = r"(?:[=(,\[?|&<]|" + _BEFORE + r"(?:return|extends|typeof|in|of|default|await|yield|new|throw|as|satisfies|const|let|var))\s*$"
_LIST = _BEFORE + r"(?:export\s+(?:type\s+)?|import\s+(?:type\s+)?|import,|export\s+(?:declare\s+)?(?:const|let|var)\s*)$"
_PATTERN = _BEFORE + r"export\s+(?:declare\s+)?(?:const|let|var)\s*$"
_DEFAULT_IMPORT = _BEFORE + r"import\s+(?:type\s+)?" + IDENT + r"\s*$"
_MODULE_NAME = _BEFORE + r"(?:from|import)\s*$"
_MEMBER_NAME = r"^\s*(?:(?:public|private|protected|static|readonly|async|declare|override|abstract|get|set)\s+)*#?[\w$\u0080-\uFFFF]+\s*$"

#: Levels within which a declaration is still the module's own.
_FLAT = r"^[eEdx]*$"
_LITERAL = "'\"qQuU`*lrRTACJ"


_built: dict[int, tuple] = {}


def once(build) -> Column:
    """``build()``, an expression over named columns, put together once per gateway:
    each of its nodes is a call to the JVM."""
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    found = _built.setdefault(id(gateway), (gateway, {}))[1]
    if build not in found:
        found[build] = build()
    return found[build]


def source_tokens(text) -> Column:
    """``array<struct<p, a>>``: the stretches of a text and the atoms behind them."""
    t = F.col(text) if isinstance(text, str) else text
    return F.arrays_zip(F.regexp_extract_all(t, F.lit(TOKEN), 1).alias("p"), F.regexp_extract_all(t, F.lit(TOKEN), 2).alias("a"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def scan_modes(tokens, markup) -> Column:
    """``struct<letters, broken>``: a letter per token, and whether a bracket,
    literal, comment or tag is unmatched. ``markup``: whether the file may hold markup.

    Letters: ``c`` code; ``o`` code that ends where a literal, comment or markup
    starts; ``x`` inside one; ``z`` where it ends as a value, ``b`` as a blank,
    ``n`` as a line end; ``p`` a member's name that reads like a keyword; ``e`` code that
    ends in a bracket of the module's own; ``S`` of a module's name.
    Capitals are the module's own.
    """
    markup = F.lit(markup) if isinstance(markup, bool) else markup

    def step(acc: Column, token: Column) -> Column:
        p, a = token["p"], token["a"]
        st, top, last, out, flat, bad = (acc[f] for f in ("st", "top", "last", "out", "flat", "bad"))
        blank = F.trim(p) == ""
        seen = F.when(blank, last).otherwise(p)

        def to(letter, st=st, top=top, last=last, flat=flat, bad=bad) -> Column:
            letter = F.lit(letter) if isinstance(letter, str) else letter
            last = F.lit(last) if isinstance(last, str) else last
            return F.struct(st.alias("st"), top.alias("top"), last.alias("last"), F.concat(out, letter).alias("out"), flat.alias("flat"), bad.alias("bad"))

        own = lambda lower, upper: F.when(flat, upper).otherwise(lower)

        def push(level, letter, last="(", keep=False, under=st) -> Column:
            level = F.lit(level) if isinstance(level, str) else level
            return to(letter, F.concat(under, level), level, last, flat if keep else F.lit(False))

        def cut(s: Column, n: int = 1) -> Column:
            return F.substring(s, F.lit(1), F.length(s) - n)

        def pop(lower, upper, last=last, n: int = 1, bad=bad, under=st) -> Column:
            """A level less; the letter by where that leads."""
            def then(s: Column) -> Column:
                flat_now = (s == "") | s.rlike(_FLAT)
                return to(F.when(flat_now, upper).otherwise(lower), s, F.substring(s, -1, 1), last, flat_now, bad)
            return _let(cut(under, n), then)

        # ---- inside literals, comments and markup
        inside = to("x")
        quoted = F.when(a == F.when(top.isin("'", "q", "u"), "'").otherwise('"'),
                        F.when(top.isin("q", "Q"), pop("S", "S", "0")).otherwise(pop("z", "Z", "0"))).when(
            (a == "\n") & ~top.isin("u", "U"), pop("n", "N", ";", bad=F.lit(True))).otherwise(to(F.when(top.isin("q", "Q"), "S").otherwise("x")))
        template = F.when(a == "`", pop("z", "Z", "0")).when(a == "${", push("$", "x")).otherwise(inside)
        regex = F.when(a.contains("/") & ~a.startswith("\\"), pop("z", "Z", "0")).when(a == "[", push("R", "x")).when(a == "\n", pop("n", "N", ";")).otherwise(inside)
        in_class = F.when(a == "]", pop("x", "x")).when(a == "\n", pop("n", "N", ";", n=2)).otherwise(inside)
        opened = F.when((a == "<>") | (F.length(a) > 2) & a.endswith(">"), push("J", "x")).otherwise(push("T", "x"))
        children = (F.when(a.isin("{", "${"), push("j", "x")).when(a == "</", to("x", F.concat(cut(st), F.lit("C")), F.lit("C")))
                    .when(a.startswith("<") & (a != "<"), opened).when(a == "}", to("x", bad=F.lit(True))).otherwise(inside))
        closing = F.when(a == ">", pop("z", "Z", "0")).otherwise(inside)
        tag = (F.when(a == "/>", pop("z", "Z", "0")).when(a == ">", to("x", F.concat(cut(st), F.lit("J")), F.lit("J")))
               .when(a.isin("{", "${"), push("j", "x")).when(a == "'", push("u", "x")).when(a == '"', push("U", "x"))
               .when(a == "/*", push("*", "x")).when(a == "//", push("l", "x")).when(a.startswith("<") & (a != "</"), push("A", "x")).otherwise(inside))
        angle = F.when(a == ">", pop("x", "x")).when(a.startswith("<"), push("A", "x")).otherwise(inside)
        literal = (F.when(top == "l", F.when(a == "\n", pop("n", "N")).otherwise(inside))
                   .when(top == "*", F.when(a == "*/", pop("b", "b")).otherwise(inside))
                   .when(F.instr(F.lit("'\"qQuU"), top) > 0, quoted).when(top == "`", template).when(top == "J", children).when(top == "T", tag)
                   .when(top == "C", closing).when(top == "r", regex).when(top == "R", in_class).otherwise(angle))

        # ---- in code
        code = own("c", "C")
        operand = seen.rlike(_OPERAND) & ~seen.rlike(_NO_OPERAND)
        stray = top.isin("x", "d")
        stripped = F.regexp_replace(st, "[xd]+$", "")

        def swept(body) -> Column:
            """``body(stack, its top)`` once ``extends`` and ``class`` that lead nowhere are gone."""
            return _let(F.when(stray, stripped).otherwise(st), lambda s: body(s, F.substring(s, -1, 1)))

        line_end = to(code, last=F.when((top == "M") & seen.rlike(_OPERAND), ";").otherwise(seen))
        comma = swept(lambda s, t: to(code, s, t, F.when(seen.rlike(_DEFAULT_IMPORT), "import,").otherwise(",")))
        semicolon = swept(lambda s, t: to(code, s, t, ";"))
        # A list of type parameters that ends before a call's parentheses is no conditional type.
        call = F.when((top == "x") & blank & (last == ">"), cut(st)).otherwise(st)
        paren = push(F.when(seen.rlike(_CONTROL), "i").otherwise("("), F.when((top == "M") & p.rlike(_METHOD), "p").otherwise(code), under=call)
        closed_paren = swept(lambda s, t: F.when(t.isin("(", "i"), pop("c", F.when(flat, "C").otherwise("e"), F.when(t == "i", ";").otherwise("0"), under=s))
                             .otherwise(to(code, bad=F.lit(True))))
        in_pattern = top.isin("e", "E") & ~seen.rlike(r"=\s*$")
        bracket = F.when(flat & (in_pattern | seen.rlike(_PATTERN)), push("E", "C", keep=True)).otherwise(push("[", code))
        closed_bracket = swept(lambda s, t: F.when(t.isin("[", "E"), pop("c", F.when(flat, "C").otherwise("e"), "0", under=s)).otherwise(to(code, bad=F.lit(True))))

        def brace(s: Column, t: Column) -> Column:
            members = seen.rlike(_MEMBERS) | (seen.rlike(r":\s*$") & t.isin("M", "(", "[", "e", "E", "i", "$", "j"))
            return (F.when(t == "d", push("M", code, under=cut(s)))
                    .when(flat & (in_pattern | seen.rlike(_LIST)), push("e", "C", keep=True, under=s))
                    .when(members, push("M", code, under=s)).otherwise(push("{", code, "{", under=s)))

        # Members behind extends belong to a conditional type, which goes on.
        kept = F.when((top == "x") & ~seen.rlike(r"extends\s*$"), F.regexp_replace(st, "x+$", "")).otherwise(st)
        opened_brace = _let(kept, lambda s: brace(s, F.substring(s, -1, 1)))
        closed_brace = swept(lambda s, t: F.when(t.isin("{", "M", "e"), pop("c", F.when(flat, "C").otherwise("e"), F.when(t == "{", ";").otherwise("0"), under=s))
                             .when(t.isin("$", "j"), pop("o", "o", under=s)).otherwise(to(code, bad=F.lit(True))))
        quote = F.when(flat & seen.rlike(_MODULE_NAME), push(F.when(a == "'", "q").otherwise("Q"), "C")).otherwise(push(a, own("o", "O")))
        slash = F.when(operand, to(code, last=a)).otherwise(push("r", own("o", "O")))
        less = F.when(markup & (F.length(a) == 2) & (a != "</") & ~operand, push(F.when(a == "<>", "J").otherwise("T"), own("o", "O"))).otherwise(to(code, last="<"))
        # Not a choice: behind extends in a type, or behind a member's name.
        optional = (top == "M") & p.rlike(_MEMBER_NAME) & F.rtrim(last).isin("{", ";", ",", "0", "(")
        question = (F.when(top == "x", pop("o", "O", "?")).when(optional, to(own("o", "O"), last="?")).otherwise(to(code, last="?")))
        heritage = F.when(top == "d", to(code, last=a)).otherwise(push("x", code, a, keep=True))
        in_code = (F.when(a == "\n", line_end).when(a == "(", paren).when(a == ")", closed_paren).when(a == ",", comma).when(a == "{", opened_brace)
                   .when(a == "}", closed_brace).when(a == ";", semicolon).when(a.isin("'", '"'), quote).when(a == "[", bracket).when(a == "]", closed_bracket)
                   .when(a == "//", push("l", own("o", "O"), seen)).when(a == "/*", push("*", own("o", "O"), seen)).when(a == "`", push("`", own("o", "O")))
                   .when(a.isin("/", "/>"), slash).when(a.startswith("<"), less).when(a == "?", question).when(a == "extends", heritage)
                   .when(a.isin("class", "interface"), push("d", code, a, keep=True)).when(a == "", to(code, last=seen)).otherwise(to(code, last=a)))
        return F.when((top != "") & (F.instr(F.lit(_LITERAL), top) > 0), literal).otherwise(in_code)

    start = F.struct(F.lit("").alias("st"), F.lit("").alias("top"), F.lit(";").alias("last"), F.lit("").alias("out"), F.lit(True).alias("flat"), F.lit(False).alias("bad"))
    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc["out"].alias("letters"), (acc["bad"] | ~acc["st"].rlike("^[xd]*l?$")).alias("broken")))


def _rendered(tokens: Column, letters: Column, one) -> Column:
    return F.array_join(F.zip_with(tokens, F.split(letters, ""), one), "")


def code_text(tokens, letters) -> Column:
    """The source as code: each literal a plain value (`` 0 ``), comments and markup blank."""
    return _rendered(tokens, letters, lambda t, m: F.when(m.isin("c", "C", "e"), F.concat(t["p"], t["a"])).when(m.isin("o", "O"), F.concat(t["p"], F.lit(" ")))
                     .when(m.isin("z", "Z", "S"), " 0 ").when(m.isin("n", "N"), "\n").when(m == "p", t["a"]).otherwise(" "))


def module_text(tokens, letters) -> Column:
    """What stands outside all brackets, with import, export and pattern lists and the names of modules."""
    return _rendered(tokens, letters, lambda t, m: F.when(m.isin("C", "S"), F.concat(t["p"], t["a"])).when(m == "O", F.concat(t["p"], F.lit(" ")))
                     .when(m == "Z", " 0 ").when(m == "N", "\n").when(m == "e", t["a"]).otherwise(""))


def modes_column() -> Column:
    """:func:`scan_modes` of the columns ``_tokens`` and ``_markup``."""
    return scan_modes(F.col("_tokens"), F.col("_markup"))
