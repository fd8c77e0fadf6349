"""Per-file metrics (P1-P5): the reference's metric behaviours on inline
sources plus a hand-counted fixture."""

import os

from faultline.operators.metrics import file_metrics

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "tangled.ts")


def metrics(spark, sources):
    df = spark.createDataFrame([("r", p, c) for p, c in sources],
                               "repo string, path string, content string")
    return {r.path: r for r in file_metrics(df).collect()}


def test_fixture_hand_counts(spark):
    src = open(FIXTURE).read()
    m = metrics(spark, [("tangled.ts", src)])["tangled.ts"]
    assert m.lines == src.count("\n") + 1 == 52
    # 1 + if x2, || x2, for, ??, &&, while, case x2, do-while, catch, ternary
    assert m.complexity == 14
    assert m.exported_symbols == ["Job", "runJob", "LIMIT", "default", "publicHelper"]
    assert m.import_count == 4
    assert m.imported_from == ["fs/promises", "path", "./config", "./polyfills"]
    assert m.imported_symbol_names == ["readFile", "path", "load", "Config"]
    assert m.has_syntax_errors is False


def test_plain_sources(spark):
    got = metrics(spark, [
        ("open.ts", "export const load = async (url) => {\n  await get(url, [1, 2;\n  log('never closed"),
        ("whole.ts", "export class Meter { read(at: Date) { return at.getTime(); } }"),
        ("branch.ts", "export const sign = (n: number) => {\n  if (n < 0) { return '-'; }\n  return '+';\n};"),
        ("straight.ts", "export const twice = (n: number) => n * 2;"),
        ("uses.ts", '\n import { open, close } from "./door";\n'
                    " const inner = () => open() || close();\n"
                    " export const enter = () => inner();\n"),
    ])
    assert got["open.ts"].has_syntax_errors is True
    assert got["whole.ts"].has_syntax_errors is False
    assert got["branch.ts"].complexity == 2
    assert got["straight.ts"].complexity == 1
    uses = got["uses.ts"]
    assert uses.imported_symbol_names == ["open", "close"]
    assert uses.exported_symbols == ["enter"] and uses.complexity == 2


def test_literals_hide_what_they_hold(spark):
    got = metrics(spark, [
        ("regex.ts", "const q = /[\"]/g; const r = s.replace(/\\/'`/, x / y / z);\nif (/a\\/b/.test(t)) { return /[/]'/; }"),
        ("jsx.tsx", "export const P = () => <p>Don't worry, it's <b>fine</b></p>;"),
        ("template.ts", "const code = `\nimport { x } from './l1';\nexport * from './l2';\nexport const no = 1;\n`;\n// import './l3'\nimport /* odd */ { y } from \"./l4\";"),
        ("strings.ts", "const s = \"import z from './l5'\"; /* export * from './l6' */ export * from './l7';"),
        ("division.ts", "const a = (b + c) / d / e; const f = g[0] / 2; const h = 'x';"),
    ])
    assert not any(m.has_syntax_errors for m in got.values())
    assert got["regex.ts"].complexity == 2
    assert got["template.ts"].imported_from == ["./l4"] and got["template.ts"].imported_symbol_names == ["y"]
    assert got["template.ts"].star_exports == [] and got["template.ts"].exported_symbols == []
    assert got["strings.ts"].imported_from == [] and got["strings.ts"].star_exports == ["./l7"]


def test_variable_exports(spark):
    got = metrics(spark, [
        ("many.ts", "export const a = f(1, [2, 3]), b: Map<string, number> = new Map(), c = { d: 1, e };\nconst g = 1, h = 2;"),
        ("bound.ts", "export const { i, j: k, l = 4, ...m } = obj;\nexport let [n, , o] = arr;\nexport var p;"),
        ("arrow.ts", "export const run = (x, y) => {\n  const inner = 1, other = 2;\n  return inner;\n};\nexport const after = 1"),
        ("lines.ts", "export const q = 1\nexport const r = 2,\n  s = 3\nfunction t() {}\nexport const enum Kind { A, B }"),
    ])
    assert got["many.ts"].exported_symbols == ["a", "b", "c"]
    assert got["bound.ts"].exported_symbols == ["i", "k", "l", "m", "n", "o", "p"]
    assert got["arrow.ts"].exported_symbols == ["run", "after"]
    assert got["lines.ts"].exported_symbols == ["q", "r", "s", "Kind"]


def test_case_is_a_clause(spark):
    got = metrics(spark, [("prop.ts", "const o = { case: 1 }; o.case; const { case: x } = o;"),
                          ("clause.ts", "switch (k) { case 'a': break; case (b): break; case C.D: break; default: }")])
    assert got["prop.ts"].complexity == 1 and got["clause.ts"].complexity == 4


def test_operators_not_counted(spark):
    got = metrics(spark, [
        ("a.ts", "a ||= b; c &&= d; e ??= f; g?.h; type T = { x?: number };"),
        ("b.ts", "const s = 'if (x) && y'; // while (z)\n/* case 1: */ const t = `a ? b : c`;"),
        ("c.ts", "for await (const x of y) {} promise.catch(e => e); try {} catch {}"),
    ])
    assert got["a.ts"].complexity == 1
    assert got["b.ts"].complexity == 1
    assert got["c.ts"].complexity == 3


def test_import_forms(spark):
    src = ('import def, * as ns from "./a";\nimport type { T, U as V } from "./types";\n'
           'export { x } from "./x";\nconst m = import("./lazy");\nimport "./side";\n')
    m = metrics(spark, [("i.ts", src)])["i.ts"]
    assert m.import_count == 3
    assert m.imported_from == ["./a", "./types", "./side"]
    assert m.imported_symbol_names == ["def", "ns", "T", "U"]
    assert m.exported_symbols == ["x"]


def test_templates_and_markup_are_read_by_mode(spark):
    got = metrics(spark, [
        ("css.tsx", "const s = css`${p => p.on ? `a{${c}` : \"\"}`;"),
        ("url.tsx", "const a = <p>see http://x.y/z</p>;\nconst b = 'x';"),
        ("rock.tsx", "const a = <p>rock 'n roll /* not a comment `</p>;"),
        ("regex.ts", "if (x) /['\"]/.test(y); else if (z) { } /\"/.test(y);"),
        ("question.tsx", "const a = <h1>Delete this file?</h1>;"),
        ("code.ts", "const a = `${a && b ? 1 : 2}`;"),
        ("braces.ts", "const a = `}${ {a: 1}.a }{`; const b = `\\`${c}\\${d ? 1 : 2}`;"),
        ("nested.tsx", "export const P = () => <p>Don't, it's <b>fine</b> {a ? <i>x</i> : null} <Foo<T> a={b && c} s='it' /> <></> </p>;\nconst y = 'x';"),
        ("generic.tsx", "const f = <T,>(x: T) => x ? 1 : 2; const g = <T extends U>(x: T) => x ? 1 : 2; const h = useState<string>(a);"),
        ("compare.tsx", "for (let i = 0; i <n; i++) { const b = a <c && d> e; }"),
        ("comment.tsx", "function R() { return ( // it's\n <div title=\"a\nb\">it's</div>); }"),
        ("assert.ts", "const a = <any>b; const c = <Foo<T>>d;"),
    ])
    assert not any(m.has_syntax_errors for m in got.values()), [p for p, m in got.items() if m.has_syntax_errors]
    want = {"css.tsx": 2, "url.tsx": 1, "rock.tsx": 1, "regex.ts": 3, "question.tsx": 1, "code.ts": 3, "braces.ts": 1, "nested.tsx": 3, "generic.tsx": 3,
            "compare.tsx": 3, "comment.tsx": 1, "assert.ts": 1}
    assert {p: m.complexity for p, m in got.items()} == want


def test_unmatched_modes_are_broken(spark):
    sources = ["const a = `abc", "const a = `${b`;", "const a = 'x\n';", "/* open", "f(1, [2)];", "class A {", "const r = `${ {a: 1 }`;"]
    markup = ["const a = <div>;", "const a = <div><p></div>;", "const a = <p>{x</p>;", "const a = <p title='x>;"]
    got = metrics(spark, [(f"{i}.ts", s) for i, s in enumerate(sources)] + [(f"{i}.tsx", s) for i, s in enumerate(markup)])
    assert all(m.has_syntax_errors for m in got.values()), [p for p, m in got.items() if not m.has_syntax_errors]
    ends = metrics(spark, [("line.ts", "const a = 1; // it's ("), ("class.ts", "export class A extends B<C> implements D, E { x = 1 / 2 }"), ("empty.ts", "")])
    assert not any(m.has_syntax_errors for m in ends.values())


def test_question_marks_that_are_no_choice(spark):
    got = metrics(spark, [
        ("members.ts", "interface A { m?(): void; n?<T>(x: T): void\n  o?(): void\n  p?: number }\nclass B { private q?(): void; r = a ? 1 : 2 }"),
        ("types.ts", "type C = T extends U ? X : Y;\ntype R<T> = T extends (...args: any[]) => infer R ? R : T extends { a: infer V } ? V : never;\nfunction f(a? : string) {}"),
        ("choices.ts", "const a = b ? (c) : d, e = f ?.5 : 1;\nconst g = h\n  ? i\n  : j;"),
        ("object.ts", "const o = { a: x ? 1 : 2, m() { return y ?? z }, get q() { return 1 }, catch(e) {}, if(x) { if (x) {} } };"),
        ("class.ts", "class P { if(a) { return 1 } for(x) {} async catch(f) { while (f) {} } }"),
        ("switch.ts", "switch (x) { case 'a': { if (y) {} break; } default: { z(); } }"),
    ])
    assert {p: m.complexity for p, m in got.items()} == {"members.ts": 2, "types.ts": 1, "choices.ts": 4, "object.ts": 4, "class.ts": 2, "switch.ts": 3}
    assert not any(m.has_syntax_errors for m in got.values())


def test_exports_of_the_module_itself(spark):
    got = metrics(spark, [
        ("scope.ts", "namespace X { export const inner = 1; export function g() {} }\ndeclare module \"m\" { import q from 'r'; export function h(): void }\n"
                     "declare global { export interface W {} }\nexport namespace Y { export const z = 1 }\nexport const own = 1;"),
        ("alias.ts", "import B = C.D;\nimport E = require('./e');\nexport import A = B.F;\nexport type { T } from './t';\nexport * as ns from './n';\nexport type * from './types';"),
        ("deep.ts", "export const { a: { b, c = { d: 1 } }, e: [f, { g }], ['h']: i = j, ...k } = l(m, { n: 1 }), o = 1;\nexport const [p = q, [r]] = s;"),
        ("text.tsx", "export const T = () => <p>export const no = 1; import {'{'} x from './y'</p>;\nexport default T;"),
    ])
    assert got["scope.ts"].exported_symbols == ["Y", "own"] and got["scope.ts"].imported_from == []
    assert got["alias.ts"].exported_symbols == ["A", "T", "ns"] and got["alias.ts"].imported_from == [] and got["alias.ts"].star_exports == ["./types"]
    assert got["deep.ts"].exported_symbols == ["b", "c", "f", "g", "i", "k", "p", "r"]
    assert got["text.tsx"].exported_symbols == ["T", "default"] and got["text.tsx"].import_count == 0


class Writer:
    """Random source with what is in it."""

    def __init__(self, rng, markup):
        self.rng, self.markup, self.points = rng, markup, 0

    def expression(self, depth):
        r = self.rng
        kinds = ["name", "string", "regex", "number"] if depth <= 0 else ["template", "choice", "and", "object", "arrow", "call", "name", "string", "regex", "divide"] + ["tag"] * 3 * self.markup
        kind = r.choice(kinds)
        if kind == "name":
            return r.choice(["a", "b.c", "$d", "this.if", "x!"])
        if kind == "string":
            return r.choice(["'it`s ${ ( { if (a) ?'", "\"don't // /* && <p>\"", "'\\''", '"\\\\"'])
        if kind == "regex":
            return "(" + r.choice(["/['\"`]/g", "/[/{(]/", "/\\/a?/", "/<p>/"]) + ")"
        if kind == "number":
            return r.choice(["1", ".5", "0x1f"])
        one = self.expression(depth - 1)
        if kind == "template":
            return "`" + r.choice(["", "it's } ", "if (a) { ? ", "\\` \\${ "]) + "${" + one + "}" + r.choice(["", " // '", "{"]) + "`"
        if kind == "choice":
            self.points += 1
            return f"({one} ? {self.expression(depth - 1)} : {self.expression(depth - 1)})"
        if kind == "and":
            self.points += 1
            return f"({one} {r.choice(['&&', '||', '??'])} {self.expression(depth - 1)})"
        if kind == "object":
            return f"({{ a: {one}, if(x) {{ return {self.expression(depth - 1)}; }}, [b]: 1 }})"
        if kind == "arrow":
            self.points += 1
            return f"((a?: T) => {{ if ({one}) {{ return {self.expression(depth - 1)}; }} /* ' */ }})"
        if kind == "divide":
            return f"({one} / {self.expression(depth - 1)} / 2)"
        if kind == "call":
            return f"f<T>({one}, {self.expression(depth - 1)})"
        return (f"(<b title=\"it's\" on={{{one}}} {{...p}}>it's {{{self.expression(depth - 1)}}} a `?` // {{/* ' */}}<br/></b>)")

    def statement(self):
        r = self.rng
        kind = r.randrange(6)
        one = self.expression(3) if kind != 2 else ""
        if kind == 0:
            self.points += 1
            return f"while ({one}) {{ x++; }} // it's"
        if kind == 1:
            return f"class A<T> extends B {{ m?(): void; catch(e) {{ return {one}; }} }}"
        if kind == 2:
            return "type C<T> = T extends (infer U)[] ? U : never; interface D { e?(): void }"
        if kind == 3:
            self.points += 2
            return f"switch (a) {{ case 'b': {{ break; }} case (c): return {one}; default: {{ }} }}"
        return f"const v = {one};"


def test_random_sources(spark):
    import random
    rng, rows, want = random.Random(11), [], {}
    for i in range(400):
        w = Writer(rng, i % 2)
        text = "\n".join(w.statement() for _ in range(rng.randrange(1, 5)))
        rows.append((f"{i}.ts" + "x" * (i % 2), text))
        want[rows[-1][0]] = 1 + w.points
    got = metrics(spark, rows)
    for path, text in rows:
        assert (got[path].complexity, got[path].has_syntax_errors) == (want[path], False), text
