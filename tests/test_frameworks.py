from __future__ import annotations

import pytest

from custodia.operators import frameworks, projects

#: One project of each framework, with the confidence and the number of modules' files that it must come out with.
PROJECTS = {
    "Laravel": ({"artisan": "", "composer.json": "{}", "app/Http/Controllers/A.php": ""}, 50), "Gin": ({"go.mod": "module x\nrequire gin-gonic/gin v1\n", "main.go": ""}, 60), "ThinkPHP": ({"composer.json": "topthink/framework", "think": "", "route/a.php": ""}, 60), "Symfony": ({"composer.json": "symfony/framework-bundle", "bin/console": ""}, 45),
    "Go-Zero": ({"go.mod": "zeromicro/go-zero", "etc/a.yaml": "", "internal/logic/a.go": ""}, 55), "Spring Boot": ({"pom.xml": "spring-boot", "src/main/java/A.java": "@SpringBootApplication class A {}", "src/main/resources/application-dev.yml": ""}, 50), "Django": ({"manage.py": "", "requirements.txt": "Django==5\n"}, 45),
    "Flask": ({"requirements.txt": "flask\n", "app.py": ""}, 40), "FastAPI": ({"requirements.txt": "fastapi\n", "routers/a.py": ""}, 35), "NestJS": ({"package.json": '{"dependencies": {"@nestjs/core": "1"}}', "nest-cli.json": ""}, 55), "Express": ({"package.json": '{"dependencies": {"express": "1"}}', "routes/a.js": ""}, 40),
    "React": ({"package.json": '{"dependencies": {"react": "1"}}', "src/App.tsx": ""}, 40), "Vue": ({"package.json": '{"dependencies": {"vue": "1"}}', "vite.config.ts": "", "src/views/a.vue": ""}, 40), "Next.js": ({"package.json": '{"dependencies": {"next": "1"}}', "pages/a.tsx": ""}, 45), "Angular": ({"package.json": "@angular/core", "angular.json": ""}, 60),
    "Nuxt": ({"package.json": '"nuxt"', "nuxt.config.ts": ""}, 55), "SvelteKit": ({"package.json": "@sveltejs/kit", "src/routes/a.svelte": ""}, 55), "Electron": ({"package.json": '"electron"', "electron/main.ts": ""}, 65), "Rails": ({"Gemfile": "gem 'rails'", "config/routes.rb": "", "app/models/a.rb": ""}, 60), "Sinatra": ({"Gemfile": "gem 'sinatra'", "app.rb": ""}, 45),
    "ASP.NET Core": ({"src/Shop/Shop.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web">', "Program.cs": "WebApplication.CreateBuilder(args)"}, 55), "Flutter": ({"pubspec.yaml": "flutter:\n", "lib/main.dart": ""}, 50), "Android": ({"settings.gradle": "", "app/build.gradle": "", "app/src/main/kotlin/A.kt": ""}, 45),
    "iOS": ({"Shop.xcodeproj/project.pbxproj": "", "Podfile": ""}, 60), "Phoenix": ({"mix.exs": "{:phoenix, 1}", "lib/a.ex": ""}, 45), "Ktor": ({"build.gradle.kts": "io.ktor", "src/main/kotlin/A.kt": ""}, 40), "Tauri": ({"src-tauri/Cargo.toml": "tauri = 2", "src-tauri/src/main.rs": ""}, 45),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(name, path, content) for name, (held, _) in PROJECTS.items() for path, content in held.items()]
    rows += [("none", "lib/a.txt", ""), ("none", "odd/b.txt", ""), ("none", ".x/c", ""), ("none", "d", None), ("none", "lib/a.txt", "")]
    return spark.createDataFrame([(*r, "x") for r in rows], "repo_id string, file_path string, content string, path string")


def test_every_framework_scores(files):
    found = {r["repo_id"]: (r["framework"], r["confidence"]) for r in frameworks.framework_scores(files).where("place = 1").collect()}
    assert found == {name: (name, confidence) for name, (_, confidence) in PROJECTS.items()}


def test_generic_modules_where_no_framework_gives_any(files):
    scores = frameworks.framework_scores(files)
    rest = frameworks.generic_modules(files, frameworks.module_files(files, scores)).where("repo_id = 'none'").collect()
    assert {(r["ordinal"], r["name"], r["kind"], r["file_path"]) for r in rest} == {(2, "lib", "other", "lib/a.txt"), (11, "odd", "other", "odd/b.txt")}


def test_entries(spark):
    held = {
        "Laravel": ({"routes/api.php": "Route::get('/a', x);\nRoute::any(\"/b\", y);\n", "app/A.php": "protected $signature = 'order:sync {id}';\n protected $table = 'orders';\n"}, {("route", "GET /a"), ("route", "ANY /b"), ("command", "order:sync"), ("table", "orders")}),
        "Spring Boot": ({"src/main/java/B.java": "@GetMapping(\"/c\")\n@RequestMapping(value = \"/d\")\n@Table(name = \"t\")\n"}, {("route", "GET /c"), ("route", "ANY /d"), ("table", "t")}), "Flask": ({"a.py": "@app.route('/e')\n@bp.post('/f')\n"}, {("route", "ANY /e"), ("route", "POST /f")}),
        "Express": ({"routes/b.js": "router.post('/g', h)\napp.use('/i', j)\n"}, {("route", "POST /g"), ("route", "ANY /i")}), "Rails": ({"config/routes.rb": "  get 'k'\n  resources :l\n"}, {("route", "GET k"), ("route", "ANY l")}), "ASP.NET Core": ({"Controllers/A.cs": "[HttpGet(\"/m\")]\n"}, {("route", "GET /m")}), "Gin": ({"r.go": "r.POST(\"/n\", f)\n"}, {("route", "POST /n")}),
    }
    rows = [(name, path, content) for name, (extra, _) in held.items() for path, content in (PROJECTS[name][0] | extra).items()]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string")
    got = {}
    for r in frameworks.module_entries(df, frameworks.framework_scores(df)).collect():
        got.setdefault(r["repo_id"], set()).add((r["kind"], r["entry"]))
    assert got == {name: wanted for name, (_, wanted) in held.items()}


MANIFESTS = {
    "package.json": ('{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "1"}}', ("Node.js", 2, 1, "npm")), "composer.json": ('{"require": {"a": "1"}, "require-dev": {"b": "1", "c": "2"}}', ("PHP Composer", 1, 2, "composer")), "go.mod": ("module x\n\nrequire (\n\ta/b v1.0.0\n\tc/d v2.0.0 // indirect\n)\nrequire e/f v3.0.0\n", ("Go Modules", 3, None, "go")),
    "pom.xml": ("<dependency>a</dependency><dependency>", ("Java Maven", 2, None, "maven")), "build.gradle.kts": ("implementation(\"a\")\napi \"b\"\ntestImplementation 'c'\n", ("Java Gradle", 3, None, "gradle")), "requirements.txt": ("a==1\n\n# note\n b\n", ("Python pip", 2, None, "pip")),
    "pyproject.toml": ('[project]\ndependencies = [\n  "a>=1",\n  "b",\n]\n[tool.poetry.dependencies]\npython = "3"\nc = "1"\n[x]\nd = 1\n', ("Python pyproject", 4, None, "python")), "Pipfile": ('[packages]\na = "*"\nb = "*"\n[dev-packages]\nc = "*"\n', ("Python Pipenv", 2, 1, "pipenv")), "Gemfile": ("gem 'rails'\n  gem \"b\"\n# gem 'c'\n", ("Ruby Bundler", 2, None, "bundler")),
    "Cargo.toml": ('[package]\nname = "x"\n[dependencies]\na = "1"\n[dev-dependencies]\nb = "1"\nc = "1"\n', ("Rust Cargo", 1, 2, "cargo")), "pubspec.yaml": ("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  a: ^1\ndev_dependencies:\n  b: ^2\nflutter:\n  uses: true\n", ("Dart / Flutter pub", 2, 1, "flutter")),
    "mix.exs": ("[{:phoenix, \"1\"}, {:b, \"2\"}]", ("Elixir Mix", 2, None, "mix")), "Package.swift": (".package(url: 1), .package (url: 2)", ("Swift Package Manager", 2, None, "swift")), "Podfile": ("pod 'a'\n  pod \"b\"\n", ("iOS CocoaPods", 2, None, "cocoapods")), "a.csproj": ("<PackageReference Include='a'/><PackageReferences/>", (".NET NuGet", 1, None, "dotnet")),
}


def test_manifests_of_every_ecosystem(spark):
    rows = [(name, name, content) for name, (content, _) in MANIFESTS.items()] + [("bad", "package.json", "{broken"), ("no", "main.py", "x"), ("null", "go.mod", None)]
    df = spark.createDataFrame(rows + rows[:2], "repo_id string, file_path string, content string")
    got = {r["repo_id"]: (r["ecosystem"], r["dependencies"], r["dev_dependencies"], r["manager"]) for r in projects.manifests(df).collect()}
    assert got == {name: wanted for name, (_, wanted) in MANIFESTS.items()}


def test_commands_that_manifests_and_files_imply(spark):
    rows = [
        ("rails", "x/Gemfile", "gem 'rails'\n"), ("phx", "mix.exs", "{:phoenix, 1}"), ("mix", "mix.exs", "{:a, 1}"), ("boot", "pom.xml", "<dependency>"), ("boot", "src/main/resources/application.yml", ""), ("plain", "pom.xml", ""), ("net", "a/b.csproj", ""), ("dart", "pubspec.yaml", ""), ("gradle", "build.gradle", ""), ("gradle", "conf/application.properties", ""), ("make", "Makefile", ""), ("empty", "README.md", ""),
    ]
    got = {}
    for r in projects.start_commands(spark.createDataFrame(rows, "repo_id string, file_path string, content string")).orderBy("part", "ordinal").collect():
        got.setdefault(r["repo_id"], []).append(r["command"])
    assert got == {
        "rails": ["cd x && bundle install", "cd x && bundle exec rails server"], "phx": ["mix deps.get", "mix phx.server", "mix run"], "mix": ["mix deps.get", "mix run"], "boot": ["mvn spring-boot:run"], "net": ["dotnet run --project a/b.csproj"], "dart": ["flutter pub get", "flutter run"], "gradle": ["./gradlew bootRun"], "make": ["make"],
    }


def test_modules_by_directory_and_extension(spark):
    held = {
        "Django": {"shop/views.py": "", "templates/a.html": "", "templates/b.txt": ""}, "Nuxt": {"pages/a.vue": "", "server/api/b.ts": "", "pages/c.md": ""}, "ASP.NET Core": {"Controllers/A.cs": "", "Pages/a.razor": ""}, "Android": {"app/src/main/res/a/b.xml": ""}, "iOS": {"Sources/a.swift": "", "ios/b.plist": ""}, "Ktor": {}, "Sinatra": {"lib/x.rb": ""},
    }
    rows = [(name, path, content) for name, extra in held.items() for path, content in (PROJECTS[name][0] | extra).items()]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string")
    got = {}
    for r in frameworks.module_files(df, frameworks.framework_scores(df)).collect():
        got.setdefault(r["repo_id"], set()).add((r["name"], r["file_path"]))
    assert got == {
        "Django": {("Views", "manage.py"), ("Views", "shop/views.py"), ("Templates", "templates/a.html")}, "Nuxt": {("Pages", "pages/a.vue"), ("Server Routes", "server/api/b.ts")}, "ASP.NET Core": {("Controllers", "Controllers/A.cs"), ("Pages", "Pages/a.razor")},
        "Android": {("Activities / Kotlin", "app/src/main/kotlin/A.kt"), ("Resources", "app/src/main/res/a/b.xml"), ("Configuration", "app/build.gradle"), ("Configuration", "app/src/main/res/a/b.xml"), ("Configuration", "app/src/main/kotlin/A.kt")} - {("Configuration", "app/src/main/kotlin/A.kt")},
        "iOS": {("Swift Sources", "Sources/a.swift"), ("Resources", "ios/b.plist")}, "Ktor": {("Kotlin Source", "src/main/kotlin/A.kt")}, "Sinatra": {("Ruby Source", "app.rb"), ("Ruby Source", "lib/x.rb")},
    }
