from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from custodia.functions import history, paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "language", "module", "area"),
    [
        ("app/Http/Controllers/OrderController.php", "PHP", "OrderController", "Controllers"),
        ("app/Services/Billing/Run.php", "PHP", "Billing", "Services/Billing"),
        ("resources/a.blade.php", "Blade", "resources/a.blade", "resources/a.blade.php"),
        ("ios/App/View.m", "Objective-C", "ios/App", "ios/App"),
        ("lib/View.m", "MATLAB", "lib/View", "lib/View.m"),
        ("Dockerfile", "Dockerfile", "Dockerfile", "Dockerfile"),
        ("routes/api.php", "PHP", "routes/api", "routes"),
        ("src/unknown.zzz", None, "src/unknown", "src/unknown.zzz"),
        ("", None, "Root", "Other"),
    ],
)
def test_paths(spark, path, language, module, area):
    p = F.lit(path)
    row = spark.range(1).select(paths.language(p).alias("l"), paths.module_name(p).alias("m"), paths.business_area(p).alias("a")).first()
    assert (row["l"], row["m"], row["a"]) == (language, module, area)


def test_path_predicates(spark):
    yes = {"is_sensitive": [".env", "a/.env.local", "id_rsa", "x/secrets.json", "k.pem"], "is_config": ["config/app.php", "a.yml"], "is_manifest": ["a/package.json", "x.csproj"], "in_ignored_directory": ["a/node_modules/b.js", "dist/x"], "is_binary": ["a.PNG"], "is_readme": ["README.md", "x/readme"]}
    no = {"is_sensitive": [".env.example", "environment.ts", "my_id_rsa_notes"], "is_config": ["a.py"], "is_manifest": ["package.json.bak"], "in_ignored_directory": ["distant/x", "dist"], "is_binary": ["a.png.txt"], "is_readme": ["myreadme"]}
    for wanted, table in ((True, yes), (False, no)):
        for name, values in table.items():
            for value in values:
                assert one(spark, getattr(paths, name)(F.lit(value))) is wanted, (name, value)


def test_normal_path(spark):
    assert one(spark, paths.normal_path(F.lit(" \\a\\b/c.py "))) == "a/b/c.py"


@pytest.mark.parametrize(("printed", "path"), [("src/{a => b}/c.txt", "src/b/c.txt"), ("src/{api => }/b.txt", "src/b.txt"), ("src/{ => api}/b.txt", "src/api/b.txt"), ("a.txt => b.txt", "b.txt"), ("a.txt", "a.txt")])
def test_paths_of_line_counts(spark, printed, path):
    assert one(spark, history.stat_path(F.lit(printed))) == path


@pytest.mark.parametrize(("steps", "status"), [(["added", "modified"], "added"), (["modified", "added"], "added"), (["deleted", "modified"], "deleted"), (["added", "deleted"], "deleted"), (["deleted", "renamed"], "renamed"), (["other", "copied"], "copied"), ([], "other"), (["modified", "renamed", "deleted"], "deleted")])
def test_status_depends_on_order(spark, steps, status):
    array = F.array(*(F.lit(s) for s in steps)).cast("array<string>")
    assert one(spark, history.folded_status(array)) == status


@pytest.mark.parametrize(("target", "hit"), [("ann@x.example", True), ("<Ann@X.example>", True), ("Somebody <ANN@x.example>", True), ("ann lee", True), ("Ann", False), ("", False), ("bob@x.example", False)])
def test_author_forms(spark, target, hit):
    assert one(spark, history.is_author(target, F.lit("Ann Lee"), F.lit(" <ann@x.example> "))) is hit


def test_risk(spark):
    level = lambda p, c, n: one(spark, history.risk_level(F.lit(p), F.lit(c), F.lit(n)))
    assert [level(0, 1, 1), level(0, 5, 0), level(1, 1, 1), level(3, 1, 1), level(0, 12, 0), level(0, 0, 1000)] == ["low", "medium", "medium", "high", "high", "high"]
    assert level(None, None, None) == "low"


def test_text_functions(spark):
    assert one(spark, text.html_escape(F.lit("<a b=\"c\">&'"))) == "&lt;a b=&quot;c&quot;&gt;&amp;&#39;"
    assert one(spark, text.snippet(F.lit("a  `b`\n" + "x" * 100), 20)) == "a 'b' xxxxxxxxxxxxxx..."
    assert [one(spark, text.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\n\nb")] == [0, 1, 1, 3]
    assert one(spark, text.routes(F.lit("Route::get('/a', x)\nRoute::any('/a')\n@GetMapping(\"/b/{id}\")\nr.POST(\"/c\", h)\nRoute::get('/a')"))) == ["GET /a", "ANY /a", "POST /c", "GET /b/{id}"]
    assert [one(spark, text.repository_name(F.lit(u))) for u in ("https://x/y/a.git?z", "git@h:o/b c.git", "ssh://h/", "")] == ["a", "b-c", "h", "repository"]
    assert [one(spark, text.confidence_percent(F.lit(v))) for v in (0.5, 1.0, 55.4, 140.0, -3.0)] == [50, 100, 55, 100, 0]
    assert one(spark, text.parameter_names(F.lit("$a = 1, string $b, { c }: T, ...d, e?: number"))) == ["a", "b", "c", "d", "e"]
    assert one(spark, text.call_key(F.lit("a.b::c->save(x)"))) == "save"
    assert [one(spark, text.import_kind(F.lit(p))) for p in ("./a", "..", "a.b.c", "react", "App\\Models\\X")] == ["relative", "relative", "module", "package", "module"]
    assert [one(spark, text.method_intent(F.lit(n))) for n in ("createOrder", "getX", "zzz")] == ["create", "read", "other"]
    assert one(spark, text.clone_progress(F.lit("Receiving objects:  50% (1/2)"))) == ("receiving", 50)
    assert one(spark, text.without_ansi(F.lit("\x1b[31mred\x1b[0m\r\nx "))) == "red\nx"


@pytest.mark.parametrize(
    ("name", "content", "count"),
    [
        ("package.json", '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "1"}}', 2),
        ("package.json", "broken", 0),
        ("go.mod", "module x\n\nrequire (\n\ta/b v1.0.0\n\tc/d v2.0.0 // indirect\n)\nrequire e/f v3.0.0\n", 3),
        ("requirements.txt", "a==1\n\n# note\nb\n", 2),
        ("Gemfile", "gem 'a'\n  gem \"b\"\n# gem 'c'\n", 2),
        ("x.csproj", "<PackageReference/><PackageReference/>", 2),
        ("main.py", "import x", None),
    ],
)
def test_dependencies_are_counted_once(spark, name, content, count):
    assert one(spark, text.dependency_count(F.lit(content), F.lit(name))) == count
