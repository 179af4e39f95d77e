from __future__ import annotations

import ast
import random

import pytest

from custodia.llm import grammars
from custodia.llm.lexing import FIRST, pieces, states_of
from custodia.llm.summaries import joined, packed, stands, summarise, unpacked
from custodia.llm.syntax import broken_files, broken_rates, parses

GOOD = {
    "Python": ["", "# only a remark\n", "def f(a, *, b=1):\n    return f'{a[\"x\"]}'\n", "match x:\n    case [1, *rest]:\n        pass\n", "type A[T] = list[T]\n"],
    "JavaScript": [
        "", "// note\n", "export default async function* f({ a, ...b }, [c] = []) {\n  for await (const x of a) yield* x\n  return `a ${b ? `n ${c}` : '}'} z`\n}\n",
        "class A extends B {\n  #x = 1\n  static async get(y) { return this.#x ?? y?.[0]?.(1) }\n  get z() { return 1 }\n}\nexport { A as default }\n",
        "const r = a / b / c, s = /[/]x\\/(/g.test(t)\nlabel: for (;;) { if (x) continue label; else break label }\n", "!function(e,t){if(!e)throw new Error(\"}\");var a=t?1:0,b=[1,,2]}(this,{});\n",
        "let x = (a) => ({ ...a, b: 1, 'c': [2], get d() { return 3 }, async e() {}, [f]: g })\ndo x++\nwhile (x < 3)\ntry { x() } catch { y() } finally { z() }\nswitch (x) { case 1: y(); break; default: z() }\n",
    ],
    "TypeScript": [
        "import type { A } from './a'\nexport interface B<T extends A = A> extends A { a?: string; b(x: number): void; [k: string]: unknown }\ntype C = A | { x: 1 }[] | ((y: string) => void)\nenum D { X = 1, Y }\n",
        "export abstract class E<T> implements F {\n  private readonly x: Map<string, T[]> = new Map<string, T[]>()\n  constructor(private a: string, public b?: number) { super() }\n  @dec() async f<U>(this: E<T>, x: U): Promise<U | undefined> { return x as unknown as U }\n  abstract g(): void\n}\n",
        "const f = <T,>(x: T): x is T => !!x\nlet v = a!.b satisfies C\ndeclare module 'm' { const y: number }\nfunction o(a: string): void\nfunction o(a: any) { }\n",
    ],
    "Go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K]) F(a, b string, c ...int) (x int, err error) {\n\tif v, ok := m[a]; ok && v.X() == nil {\n\t\treturn\n\t} else if b == \"\" {\n\t}\n\tfor i := range c {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := v.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase z := <-ch:\n\t\t_ = z\n\t}\n\treturn map[string][]int{\"a\": {1}}[a][0], nil\n}\n\nvar (\n\ta = 'x'\n\tb = []T{{1, 2}}\n)\n",
    ],
    "Java": [
        "", "package a.b;\n\nimport static x.Y.*;\n\n@A(b = {1, 2})\npublic sealed class C<T extends D & E> extends F<T> implements G permits H {\n    private final Map<String, List<? super T>> m = new HashMap<>();\n    static { x = 1; }\n    public C(int... a) throws IOException { this(); }\n    <U> U f(final U u) { return switch (u) { case null -> throw new X(); case String s -> u; default -> { yield u; } }; }\n    int[] g = {1, 2}, h[] = new int[3][];\n    void i() { for (var x : y) if (x instanceof String s && s.length() > 1) z(String::valueOf, (a, b) -> a + b); try (var r = q()) { } catch (A | B e) { } finally { } }\n    String t = \"\"\"\n        a \" b { \"\"\";\n    enum E { A(1) { void f() {} }, B; int x; }\n    record R(int a, String b) { R { } }\n    interface I { default int f() { return (int) 1L << 2 >>> 3; } }\n}\n",
    ],
    "PHP": [
        "<?php\n", "<html><?= $x ?></html>\n", "<?php\nnamespace A\\B;\n\nuse C\\{D, E as F};\n\n#[Attr(1)]\nabstract class G extends H implements I\n{\n    use T;\n    const X = 1;\n    private static ?array $y = ['a' => 1, ...self::Z];\n    public function __construct(private readonly int|string $a = 1, &...$b) { parent::__construct(); }\n    abstract function f(): static;\n    public function g(?int $x): ?string {\n        foreach ($x as $k => [$a, $b]) { echo \"a {$k['}']} $b\", 'c'; }\n        $f = static fn(int $q): int => $q ** 2 <=> 3;\n        $s = <<<SQL\n          it's { $x\n          SQL;\n        return match (true) { $x?->y() > 1 => 2, default => throw new E() };\n    }\n}\nif ($a instanceof B): ?> x <?php endif;\n",
    ][:3],
}
GOOD["PHP"][2] = GOOD["PHP"][2].split("if ($a instanceof")[0]


@pytest.mark.parametrize("language", GOOD)
def test_valid_sources(language):
    for text in GOOD[language]:
        assert parses(language, text), text


BAD = {
    "Python": ["def f(:\n", "x = [1\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "if x:\n  a\n b\n"],
    "JavaScript": ["const x = (1;\n", "x = 'a\n", "<<<<<<< HEAD\nx()\n=======\ny()\n>>>>>>> b\n", "class A { private f(): void {} }\n", "package a;\n", "const x = “a”;\n", "function f() {\n  return 1\n", "<?php echo 1;\n", "func f() {}\n", "Error: rate limit exceeded, retry later\n", "def f(x):\n    return x\n"],
    "TypeScript": ["let x: = 1\n", "public class A { void f() {} }\n", "def f(x):\n", "const x = `a ${b\n", "x x\n"],
    "Go": ["", "package a\n\nfunc f( {\n}\n", "package a\n\n=======\nfunc f() {}\n", "import x from 'y'\n", "package a\n\nfunc f() {\n\tx := `a\n}\n", "package a\nclass B {}\n"],
    "Java": ["class A { void f( { } }\n", "class A { int x = 'ab'; }\n", "class A {\n>>>>>>> b\n}\n", "function f() { return 1; }\n", "class A { void f() { return 1 } }\n", "def f(): pass\n"],
    "PHP": ["<?php\nfunction f( { }\n", "<?php\n$x = 'a;\n", "<?php\n<<<<<<< HEAD\n$x = 1;\n", "<?php\npublic class A { void f() {} }\n", "<?php\n$x = <<<A\n b\n"],
}


@pytest.mark.parametrize("language", BAD)
def test_broken_sources(language):
    for text in BAD[language]:
        assert not parses(language, text), text


def _chunks(language, text, size):
    states = states_of(language, text)
    return [summarise(language, c, states if k else [FIRST[language]]) for k, c in enumerate(pieces(text, size))]


@pytest.mark.parametrize("language", GOOD)
def test_the_size_of_chunks_changes_no_verdict(language):
    for texts, verdict in ((GOOD[language], True), (BAD[language], False)):
        for text in texts:
            assert {parses(language, text, size) for size in (1, 9, 40, 10_000)} == {verdict}, text


@pytest.mark.parametrize("language", GOOD)
def test_summaries_may_be_joined_in_any_grouping(language):
    random.seed(5)
    for text in (GOOD[language][-1] * 2, GOOD[language][-1] + BAD[language][0]):
        verdicts = set()
        for _ in range(8):
            parts = _chunks(language, text, 12)
            while len(parts) > 1:
                k = random.randrange(len(parts) - 1)
                parts[k : k + 2] = [unpacked(packed(joined(language, parts[k], parts[k + 1])))]
            verdicts.add(stands(language, parts[0]))
        assert verdicts == {parses(language, text)}, text


def test_templates_and_here_documents_over_chunks():
    nested = "const a = `x ${f({\nb: `y ${[1,\n2].map((z) => {\nreturn `}${z\n}`\n})}\n`\n})} }\n`\nlet c = 1\n"
    here = "<?php\n$a = <<<SQL\n it's {\n SQL;\n$b = [\n<<<'X'\n ( \n X,\n];\n"
    for language, text in (("JavaScript", nested), ("TypeScript", nested), ("PHP", here)):
        for size in (1, 10, 25):
            assert parses(language, text, size)
            assert not parses(language, text.replace("]", ")", 1), size)
    assert not parses("JavaScript", nested.replace("})}\n`\n", "})\n`\n"), 1)


def test_a_verdict_that_only_the_reduction_can_give(spark):
    lines = "x = 1;\n" * 40
    rows = [(1, "JavaScript", "f(function () {\n" + lines + "})\n"), (2, "JavaScript", "f(function () {\n" + lines + ")}\n"), (3, "JavaScript", "f([1,\n" + "2,\n" * 60 + "3 4])\n"), (4, "JavaScript", "/*\n" + "( ` '\n" * 60 + "*/ f()\n"), (5, "PHP", "<?php\n$a = '\n" + "x )\n" * 60)]
    df = spark.createDataFrame(rows + rows[:2], "file_id long, lang string, content string")
    for chunk, run in ((20, 2), (20, 64), (32_768, 64)):
        assert sorted(r["file_id"] for r in broken_files(df, "file_id", "lang", "content", chunk, run).collect()) == [2, 3, 5]


def test_deep_and_long_texts_are_decided():
    assert parses("Python", "x = " + "-" * 200_000 + "1\n") and not parses("Python", "x = " + "-" * 200_000 + "1 1 1 (\n")
    assert parses("Python", "x = " + "(" * 50_000 + "1" + ")" * 50_000 + "\n") and not parses("Python", "x = " + "(" * 50_000 + "1" + ")" * 49_999 + "\n")
    assert parses("JavaScript", "for (;;) {}\n") and not parses("JavaScript", "for (i;i;i;i) {}\n")
    assert not parses("JavaScript", "for (" + "i; " * 60 + "i) {}\n")


PYTHON = [
    ("def f(a, /, b=1, *c: int, d, **e) -> x:\n    return\n", True), ("async def f():\n    async with a as b, c:\n        await d\n    return [x async for x in y if z]\n", True), ("def f():\n    await x\n", False),
    ("return 1\n", False), ("for x in y:\n    break\nelse:\n    pass\n", True), ("break\n", False), ("try:\n    pass\nx = 1\n", False), ("try:\n    pass\nexcept* (A, B) as e:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", True),
    ("if x:\n    pass\nelif y: pass\nelse:\n\tpass\n", True), ("if x:\npass\n", False), ("if x:\n    a\n  b\n", False), ("else:\n    pass\n", False), ("@a.b(c)\nclass D(E, metaclass=F): x: int = 1; y = 2\n", True), ("@a\nx = 1\n", False),
    ("match(x)\nmatch = type = case = 1\n", True), ("match x, y:\n    case {'a': 1, **r} if r:\n        pass\n    case A(b=0) | [_, *_]:\n        pass\n", True), ("match x:\n    y = 1\n", False), ("print 'x'\n", False), ("x = [i for i in range(3) if i if not i]\n", True),
    ("from . import (a as b, c,)\nfrom ...x import *\nimport a.b as c, d\n", True), ("from import x\n", False), ("f(*b, c=1, **a)\nx = lambda *a, b=1: (a, b)\n", True), ("a[1:2, ::3, ...] = b[()] = *c, d\n", True), ("x = a[]\n", False), ("x = (a, b=1)\n", False), ("f() = 1\n", False), ("x += y := 1\n", False),
    ("if (n := 10) > 5: print(f'{n!r:>{w}} {{}}')\n", True), ("x = f'{n'\n", False), ("type A[T: int, *U, **V] = dict[T, U]\ndef g[T](x: T): ...\n", True), ("x = 1 \\\n  + 2\n", True), ("del a, b[0]\nglobal c\nassert x, 'y'\nraise A from b\n", True), ("class A:\n    '''doc\n  text'''\n    def f(self): return 'a' \"b\" r'\\c'\n", True),
]


@pytest.mark.parametrize("text,verdict", PYTHON)
def test_python_agrees_with_the_interpreter(text, verdict):
    try:
        compile(ast.parse(text), "file", "exec", dont_inherit=True)
        told = True
    except SyntaxError:
        told = False
    assert parses("Python", text) == told == verdict


def test_files(spark):
    rows = [(1, "r", "Python", "x = (\n"), (1, "r", "Python", "x = (\n"), (2, "r", "python", "x = 1\n"), (3, "r", "Cobol", "x ("), (4, "r", "Go", ""), (5, "r", "Java", ""), (None, "r", "Go", "x"), (6, "r", "PHP", None), (7, "s", "JavaScript", "f(" + "x, " * 40_000 + "y)\n"), (8, "s", "TypeScript", "f(\n" + "x,\n" * 40_000 + "y\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, repo string, lang string, content string, id string")
    assert {r["file_id"] for r in broken_files(df, "file_id", "lang", "content").collect()} == {1, 4, 8}
    rates = {(r["repo"], r["language"]): (r["files"], r["broken_files"], r["rate"]) for r in broken_rates(df, "file_id", "repo", "lang", "content").collect()}
    assert rates[("r", "Python")] == (2, 1, 0.5) and rates[("s", "TypeScript")] == (1, 1, 1.0) and rates[("s", "JavaScript")] == (1, 0, 0.0)
    assert broken_files(df.limit(0), "file_id", "lang", "content").collect() == []


OPEN_PARTS = {
    "PHP": ["<?php\n$f = function () { g(); } return $f;\n$a = 1;\n", "<?php\n$x = match (1) { 1 => 2 } if ($x) { f(); }\n$a = 1;\n", "<?php\npublic function a() { }\npublic function b() { }\npublic function c() { }\n"],
    "JavaScript": ["let a = {} let b = 1; c();\n"],
    "TypeScript": ["let a = {} let b = 1; c();\n"],
}


@pytest.mark.parametrize("language", OPEN_PARTS)
def test_a_part_before_another_must_be_closed(language):
    for text in OPEN_PARTS[language]:
        assert not parses(language, text), text
        assert parses(language, text.replace("} return", "}; return").replace("} if", "}; if").replace("} let", "}; let").replace("public ", "")), text


def test_both_ways_of_deciding_agree(monkeypatch):
    def clear():
        for known in (grammars.allowed, grammars._part, grammars.content_allowed):
            known.cache_clear()

    clear()
    monkeypatch.setattr(grammars, "_few_readings", lambda word: False)
    try:
        for language in grammars.ENTRIES:
            for text in GOOD[language]:
                assert parses(language, text), text
            for text in BAD[language] + OPEN_PARTS.get(language, []):
                assert not parses(language, text), text
        assert parses("JavaScript", "if (a) { b() } " + "else if (a) { b() } " * 3_000)
    finally:
        clear()


def test_long_files_are_judged_whole(spark):
    head = "f(1);\n" * 5_461  # up to just below 32,768 characters, so that the next line end is the edge of a chunk
    rows = [(1, "JavaScript", head + 'const s = "a\\\nb";\nf();\n'), (2, "JavaScript", head + "const t = a +\nb\n/ c / d;\n"), (3, "JavaScript", head + 'const s = "a\nb";\n')]
    df = spark.createDataFrame(rows + rows, "file_id long, lang string, content string")
    assert [r["file_id"] for r in broken_files(df, "file_id", "lang", "content").collect()] == [3]
