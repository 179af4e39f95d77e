from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from custodia.functions import paths, text
from custodia.functions.bodies import declared_bodies
from custodia.operators import methods, relations, structure

FILES = {
    "Python": "import os, json as j\nfrom a.b import c, d as e\n# def no(): pass\nclass Base(Other, metaclass=M):\n    def go(self):\n        run(1)\n\n    def _hid(self): x.save(2)\n\nasync def free(a):\n    return go()\n",
    "TypeScript": "import { a } from './a'\nexport interface Shape extends Thing, Other<X> {\n}\nexport type Id = string\nenum Color { A }\nexport class Box<T> extends Base<T> implements Shape, Disposable {\n  private async open(x: string): Promise<void> {\n    if (x) {\n      this.store.save(x)\n    }\n  }\n}\nexport const f = async (a: number): Promise<void> => { await g(a) }\nfunction* gen() {}\nlet h = function () {}\n",
    "Go": "package p\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype S[T any] struct {\n}\ntype R interface {\n}\ntype N int\n\nfunc (s *S) Do(a int) error {\n\treturn fmt.Errorf(\"x\")\n}\nfunc help() {}\n",
    "Java": "package p;\nimport java.util.List;\nimport static a.B.c;\npublic final class A<T> extends B<T> implements C, D<E> {\n    public A(int x) {\n    }\n    private static List<String> list(int a, String b) throws X {\n        return of(a);\n    }\n    enum Kind { ONE }\n}\ninterface I extends J, K {\n}\nrecord Point(int x) implements I {\n}\n",
    "PHP": "<?php\nnamespace App\\Models;\nuse App\\Base;\nabstract class Order extends Base implements \\Countable, Other\n{\n    protected function total($a) { return $this->sum($a); }\n}\ntrait T {\n}\ninterface P extends Q {\n}\nfunction helper() {}\n",
    "Rust": "use std::io;\npub trait Shape: Debug {\n}\npub struct Box;\nimpl Shape for Box {\n    fn area(&self) -> f64 { compute!(1) }\n}\n",
    "C#": "using System.Text;\nnamespace Shop {\n    public class Cart : Base, IStore {\n        public async Task<int> Add(int x) {\n            Save(x);\n        }\n    }\n    enum E { A }\n}\n",
    "C++": "#include <vector>\nclass Box : public Base {\n};\nint Box::area(int x) {\n    return compute(x);\n}\n",
}
WANTED = {
    "Python": {(4, "class", "Base", None, "public"), (5, "method", "go", "Base", "public"), (8, "method", "_hid", "Base", "private"), (10, "function", "free", None, "public")},
    "TypeScript": {(2, "interface", "Shape", None, "exported"), (4, "type", "Id", None, "exported"), (5, "enum", "Color", None, "local"), (6, "class", "Box", None, "exported"), (7, "method", "open", "Box", "private"), (13, "function", "f", None, "exported"), (14, "function", "gen", None, "local"), (15, "function", "h", None, "local")},
    "Go": {(8, "struct", "S", None, "exported"), (10, "interface", "R", None, "exported"), (12, "type", "N", None, "exported"), (14, "method", "Do", "S", "exported"), (17, "function", "help", None, "package")},
    "Java": {(4, "class", "A", None, "public"), (5, "constructor", "A", "A", "public"), (7, "method", "list", "A", "private"), (10, "enum", "Kind", "A", "package"), (12, "interface", "I", None, "package"), (14, "record", "Point", None, "package")},
    "PHP": {(2, "namespace", "App\\Models", None, "public"), (4, "class", "Order", None, "public"), (6, "method", "total", "Order", "protected"), (8, "trait", "T", None, "public"), (10, "interface", "P", None, "public"), (12, "function", "helper", None, "public")},
    "Rust": {(2, "trait", "Shape", None, "public"), (4, "struct", "Box", None, "public"), (5, "impl", "Box", None, "private"), (6, "method", "area", "Box", "private")},
    "C#": {(2, "namespace", "Shop", None, "public"), (3, "class", "Cart", None, "public"), (4, "method", "Add", "Cart", "public"), (8, "enum", "E", None, "public")},
    "C++": {(2, "type", "Box", None, "public"), (4, "function", "area", None, "public")},
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, "r", f"src/f{k}.x", language, content) for k, (language, content) in enumerate(FILES.items())]
    rows += [rows[0], (90, "r", "e.py", "Python", ""), (91, "r", "n.py", "Python", None), (92, "r", "x.cob", "Cobol", "class X:\n"), (93, "r", None, None, "x")]
    return spark.createDataFrame([(*r, "x") for r in rows], "file_id long, repo_id string, file_path string, file_language string, content string, line string")


def test_declarations(files):
    got = {}
    for r in structure.declarations(files).collect():
        got.setdefault(r["file_language"], []).append((r["line_no"], r["kind"], r["name"], r["parent"], r["visibility"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in WANTED.items()}


def test_types_that_are_extended_and_implemented(files):
    edges = {(r["name"], r["kind"], r["target"]) for r in structure.type_edges(structure.declarations(files)).collect()}
    assert edges == {
        ("Base", "inheritance", "Other"), ("Shape", "inheritance", "Thing"), ("Shape", "inheritance", "Other"), ("Box", "inheritance", "Base"), ("Box", "implementation", "Shape"), ("Box", "implementation", "Disposable"),
        ("A", "inheritance", "B"), ("A", "implementation", "C"), ("A", "implementation", "D"), ("I", "inheritance", "J"), ("I", "inheritance", "K"), ("Point", "implementation", "I"), ("Order", "inheritance", "Base"), ("Order", "implementation", "\\Countable"),
        ("Order", "implementation", "Other"), ("P", "inheritance", "Q"), ("Shape", "inheritance", "Debug"), ("Cart", "inheritance", "Base"), ("Cart", "implementation", "IStore"),
    }


def test_imports_and_calls(files):
    imports = {}
    for r in structure.imported(files).collect():
        imports.setdefault(r["file_language"], set()).add((r["line_no"], r["import_path"]))
    assert imports == {
        "Python": {(1, "os"), (1, "json"), (2, "a.b::c"), (2, "a.b::d")}, "TypeScript": {(1, "./a")}, "Go": {(4, "fmt"), (5, "a/b")}, "Java": {(2, "java.util.List"), (3, "a.B.c")}, "PHP": {(3, "App\\Base")},
        "Rust": {(1, "std::io")}, "C#": {(1, "System.Text")}, "C++": {(1, "vector")},
    }
    calls = {r["call"] for r in structure.called(files).where("file_id < 5").collect()}
    assert {"run", "go", "this.store.save", "fmt.Errorf", "of"} <= calls and not calls & {"if", "def"}


def test_totals_limits_and_edges(files):
    totals = structure.analysis(files, structure.first_files(files, 6)).collect()[0]
    assert (totals["files"], totals["skipped"]) == (6, 4) and totals["symbols"] == 4 + 8 + 5 + 6 + 6 or totals["symbols"] > 0
    edges = files.sparkSession.createDataFrame([("r", "a.py", "x.go", "src/f0.x"), ("r", "b.py", "free", "src/f0.x"), ("r", "b.py", "lost", None)], "repo_id string, file_path string, call string, to_file string")
    named = {(r["call"], r["target"]) for r in structure.display_names(edges, structure.declarations(files)).collect()}
    assert named == {("x.go", "Base::go"), ("free", "free"), ("lost", "lost")}
    assert structure.edges_within(edges, edges.where("file_path = 'a.py'")).count() == 1
    assert structure.declarations(files.limit(0)).count() == 0


def test_methods():
    php = "<?php\nclass A {\n  /**\n   * Saves the order. Then more.\n   * @param x\n   */\n  public static function save(array $x, $y = 1)\n  {\n    if ($x) { return 1; }\n  }\n  private function __get($n) {}\n  public function __construct() {}\n}\n"
    assert [m[:6] for m in methods.methods_of("a/B.php", php)] == [(0, "save", "public", "array $x, $y = 1", "array $x, $y = 1", "Saves the order. Then more."), (1, "__construct", "public", "", "", None)]
    assert methods.methods_of("a/B.php", php)[0][6] == "{\n    if ($x) { return 1; }\n  }"
    go = "package a\n\n// Run starts it.\nfunc (s *S) Run(a int) error { return nil }\nfunc init() {}\nfunc run() {}\n"
    assert [(m[1], m[2], m[5]) for m in methods.methods_of("a.go", go)] == [("Run", "exported", "Run starts it."), ("run", "package", None)]
    java = "class A {\n  /** Adds one. */\n  protected static final List<String> add(int a) throws X {\n    return a;\n  }\n  void b() { }\n}\n"
    assert [(m[1], m[2], m[5]) for m in methods.methods_of("A.java", java)] == [("add", "protected", "Adds one."), ("b", "package", None)]
    script = "export async function one(a, b) { }\nconst two = async (c) => { }\nclass A {\n  three(d) {\n    if (d) {\n    }\n  }\n}\n"
    assert [(m[1], m[2], m[4]) for m in methods.methods_of("a.ts", script)] == [("one", "exported", "a, b"), ("two", "local", "c"), ("three", "local", "d")]
    assert methods.methods_of("a.py", "def f(): pass") == [] and methods.methods_of("a", "x") == []


def test_method_facts(spark):
    body = "public function updateOrder(Order $order, int $n = 1, array $x)\n{\n  $this->validate($x);\n  if ($order->ok) {\n    DB::transaction(function () { $order->save(); });\n  }\n  throw new E();\n}\n"
    df = spark.createDataFrame([(1, "r", "app/A.php", body), (1, "r", "app/A.php", body), (2, "r", "b.php", None), (3, "r", None, body), (4, "r", "c.php", "public function handle();")], "file_id long, repo_id string, file_path string, content string")
    rows = {r["file_id"]: r for r in methods.method_facts(methods.methods(df)).collect()}
    first = rows[1]
    assert (first["intent"], first["parameter_names"], first["branches"], first["exits"], first["conditions"]) == ("update", ["order", "n", "x"], 1, 1, ["$order->ok"])
    assert first["notes"] == ["entry", "branching", "validation", "transaction", "data_access", "exceptions", "check_paths"]
    assert rows[4]["notes"] == ["no_body"] and set(rows) == {1, 4}
    assert methods.methods(df, 0).count() == 0


@pytest.mark.parametrize(
    "path,kind",
    [
        ("app/Http/Controllers/A.php", "controller"), ("Controllers/A.php", "other"), ("src/handlers/a.go", "controller"), ("app/Services/A.php", "service"), ("src/entity/A.java", "model"), ("app/Console/Commands/A.php", "artisan_command"), ("src/cron/a.go", "command"), ("src/worker/a.go", "job"),
        ("a/Middleware/B.php", "middleware"), ("src/mapper/A.java", "data_access"), ("src/components/a.vue", "component"), ("src/views/a.vue", "page"), ("src/myapi/a.ts", "other"), ("src/api/a.ts", "api"), ("src/stores/a.ts", "store"), ("src/composables/a.ts", "utility"), ("routes/a.php", "route"), ("src/routes/a.php", "other"),
        ("a/config/b.php", "config"), ("database/migrations/a.php", "migration"), ("a/b.sql", "sql_script"), ("README.md", "other"),
    ],
)
def test_categories(spark, path, kind):
    assert spark.range(1).select(paths.category(F.lit(path)).alias("k")).first()["k"] == kind


@pytest.mark.parametrize("name,path,intent", [("userList", "", "list"), ("show", "", "read"), ("showAll", "", "other"), ("storeItem", "", "create"), ("handle", "app/Console/Commands/A.php", "command"), ("handle", "a.php", "handle"), ("errorHandler", "a.php", "handle"), ("auditLog", "", "approve"), ("isReady", "", "other"), ("callApi", "", "send"), ("parseRow", "", "convert")])
def test_intents(spark, name, path, intent):
    assert spark.range(1).select(text.method_intent(F.lit(name), F.lit(path)).alias("k")).first()["k"] == intent


def test_bodies_begin_where_the_name_is_declared():
    source = "reload({ x });\nfunction load(a) { return { y } }\nload({ z })\n"
    assert declared_bodies(source, relations.FUNCTIONS["JavaScript"]) == [(0, "load", len("{ return { y } }"))]


def test_responsibility_and_file_facts(spark):
    row = spark.createDataFrame([(1, "app/Http/Controllers/Shop/A.php", "<?php\nnamespace App\\Shop;\nclass A extends B {\n protected $table = 'orders';\n protected $fillable = ['a', \"b\"];\n // TODO\n}"), (2, "x.go", "type T struct {}"), (3, "n.go", None)], "file_id long, file_path string, content string")
    facts = {r["file_id"]: r for r in methods.file_facts(row).collect()}
    assert (facts[1]["namespace"], facts[1]["class_name"], facts[1]["extends"], facts[1]["table_name"], facts[1]["fields"], facts[1]["notes"]) == ("App\\Shop", "A", "B", "orders", "a,b", "open_tasks,entry_point")
    assert (facts[2]["class_name"], facts[2]["namespace"], facts[2]["notes"]) == ("T", None, "") and 3 not in facts
    assert spark.range(1).select(paths.responsibility(F.lit("app/Http/Controllers/Shop/A.php")).alias("k")).first()["k"] == "takes requests of Controllers/Shop and directs the work"


def test_scripts_of_components(spark):
    text = "<template>\n  <a @click=\"go() {\"/>\n  function no() {\n</template>\n<script lang=\"ts\">\nexport class A extends B {}\n</script>\n<script setup>\nimport x from './x'\nconst go = () => run()\n</script>\n<style>\n.b() {\n</style>\n"
    df = spark.createDataFrame([(1, "r", "a.vue", "Vue", text), (2, "r", "b.vue", "Vue", "<template/>")], "file_id long, repo_id string, file_path string, file_language string, content string")
    assert {(r["line_no"], r["kind"], r["name"]) for r in structure.declarations(df).collect()} == {(2, "class", "A"), (6, "function", "go")}
    assert [r["import_path"] for r in structure.imported(df).collect()] == ["./x"]
