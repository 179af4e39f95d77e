"""Indicators and modules of frameworks, as data. A path that ends in ``/`` is a directory."""

from __future__ import annotations

from typing import NamedTuple


class Indicator(NamedTuple):
    framework: str
    ordinal: int
    path: str
    needles: tuple[str, ...]
    weight: int


class ModuleRule(NamedTuple):
    framework: str
    ordinal: int
    name: str
    kind: str
    directory: str
    endings: str = ""  #: extensions of its files, all if empty


# The threshold of each framework, in the order in which they are tried.
THRESHOLDS = {"Laravel": 30, "Gin": 30, "ThinkPHP": 30, "Symfony": 30, "Go-Zero": 30, "Spring Boot": 30, "Django": 30, "Flask": 25, "FastAPI": 25, "NestJS": 30, "Express": 25, "React": 25, "Vue": 25, "Next.js": 30, "Angular": 35, "Nuxt": 35, "SvelteKit": 35, "Electron": 35, "Rails": 35, "Sinatra": 30, "ASP.NET Core": 35, "Flutter": 35, "Android": 35, "iOS": 35, "Phoenix": 35, "Ktor": 35, "Tauri": 35}
REGISTRY = list(THRESHOLDS)
# The indicators of each framework in order: path, what its content must hold one of, weight.
_INDICATORS = {
    "Laravel": [("artisan", (), 20), ("composer.json", (), 15), ("app/Http/Controllers/", (), 15), ("routes/api.php", (), 10), ("routes/web.php", (), 10), ("config/app.php", (), 10), ("phpunit.xml", (), 5), ("database/migrations/", (), 10)],
    "Gin": [("go.mod", ("module",), 20), ("main.go", (), 15), ("go.mod", ("gin-gonic/gin",), 25), ("go.sum", ("gin-gonic/gin",), 10)],
    "ThinkPHP": [("composer.json", ("topthink/framework",), 30), ("think", (), 20), ("app/controller/", (), 15), ("app/model/", (), 10), ("route/", (), 10), ("config/", (), 10)],
    "Symfony": [("composer.json", ("symfony/framework-bundle", "symfony/skeleton", "symfony/runtime",), 30), ("bin/console", (), 15), ("src/Controller/", (), 15), ("config/routes/", (), 10), ("config/bundles.php", (), 10), ("templates/", (), 5)],
    "Go-Zero": [("go.mod", ("zeromicro/go-zero", "tal-tech/go-zero",), 30), ("etc/", (), 10), ("internal/handler/", (), 15), ("internal/logic/", (), 15), ("internal/svc/", (), 10), ("internal/types/", (), 10)],
    "Spring Boot": [("pom.xml", ("spring-boot",), 15), ("build.gradle", ("spring-boot",), 15), ("build.gradle.kts", ("spring-boot",), 15), ("src/main/java/", (), 10), ("src/main/resources/application.yml", (), 10), ("src/main/resources/application.properties", (), 10)],
    "Django": [("manage.py", (), 25), ("requirements.txt", ("Django", "django",), 20), ("pyproject.toml", ("django",), 20), ("Pipfile", ("django",), 15), ("templates/", (), 5)],
    "Flask": [("requirements.txt", ("Flask", "flask",), 25), ("pyproject.toml", ("flask",), 20), ("app.py", (), 15), ("wsgi.py", (), 10), ("templates/", (), 5)],
    "FastAPI": [("requirements.txt", ("fastapi", "FastAPI",), 25), ("pyproject.toml", ("fastapi",), 20), ("main.py", (), 10), ("routers/", (), 10), ("app/routers/", (), 10)],
    "NestJS": [("package.json", ("@nestjs/core",), 35), ("src/main.ts", (), 15), ("nest-cli.json", (), 20), ("src/modules/", (), 10)],
    "Express": [("package.json", ("\"express\"", "'express'",), 30), ("app.js", (), 10), ("server.js", (), 10), ("routes/", (), 10), ("controllers/", (), 10)],
    "React": [("package.json", ("\"react\"",), 30), ("src/App.jsx", (), 10), ("src/App.tsx", (), 10), ("src/components/", (), 10)],
    "Vue": [("package.json", ("\"vue\"",), 15), ("vite.config.js", (), 15), ("vite.config.ts", (), 15), ("vue.config.js", (), 10), ("src/main.js", (), 10), ("src/main.ts", (), 10), ("src/components/", (), 10), ("src/views/", (), 10), ("src/pages/", (), 10)],
    "Next.js": [("package.json", ("\"next\"",), 35), ("next.config.js", (), 15), ("next.config.mjs", (), 15), ("pages/", (), 10), ("app/", (), 10)],
    "Angular": [("package.json", ("@angular/core",), 35), ("angular.json", (), 25), ("src/app/", (), 15)],
    "Nuxt": [("package.json", ("\"nuxt\"", "\"nuxt3\"", "@nuxt/",), 35), ("nuxt.config.ts", (), 20), ("nuxt.config.js", (), 20), ("pages/", (), 10), ("server/", (), 10)],
    "SvelteKit": [("package.json", ("@sveltejs/kit",), 35), ("svelte.config.js", (), 20), ("src/routes/", (), 20)],
    "Electron": [("package.json", ("\"electron\"",), 35), ("electron/", (), 20), ("electron/main.ts", (), 10), ("main.js", (), 10)],
    "Rails": [("Gemfile", ("rails",), 35), ("config/application.rb", (), 20), ("config/routes.rb", (), 15), ("app/controllers/", (), 15), ("app/models/", (), 10)],
    "Sinatra": [("Gemfile", ("sinatra",), 30), ("app.rb", (), 15), ("config.ru", (), 15)],
    "ASP.NET Core": [("Program.cs", ("WebApplication.CreateBuilder", "CreateHostBuilder",), 20), ("Controllers/", (), 15), ("appsettings.json", (), 10)],
    "Flutter": [("pubspec.yaml", ("flutter:",), 35), ("lib/", (), 15), ("android/", (), 10), ("ios/", (), 10)],
    "Android": [("settings.gradle", (), 15), ("settings.gradle.kts", (), 15), ("app/build.gradle", (), 20), ("app/src/main/AndroidManifest.xml", (), 25), ("app/src/main/java/", (), 10), ("app/src/main/kotlin/", (), 10)],
    "iOS": [("Podfile", (), 25), ("Package.swift", (), 20), ("Sources/", (), 10)],
    "Phoenix": [("mix.exs", (":phoenix", "Phoenix",), 35), ("config/config.exs", (), 15), ("lib/", (), 10), ("priv/repo/", (), 10)],
    "Ktor": [("build.gradle.kts", ("io.ktor",), 30), ("build.gradle", ("io.ktor",), 30), ("pom.xml", ("ktor-server",), 25), ("src/main/kotlin/", (), 10), ("src/main/resources/application.conf", (), 10)],
    "Tauri": [("src-tauri/Cargo.toml", ("tauri",), 35), ("src-tauri/tauri.conf.json", (), 20), ("src-tauri/src/", (), 10)],
}
INDICATORS = [Indicator(name, k, *row) for name, rows in _INDICATORS.items() for k, row in enumerate(rows)]
# Indicators that name no single path: framework, pattern of the path, pattern of the content or none, weight. One file is enough.
PATTERN_INDICATORS = [
    ("Spring Boot", r"^src/main/resources/application-[^/]*\.yml$", "", 5), ("Spring Boot", r"^src/main/resources/application-[^/]*\.properties$", "", 5), ("Spring Boot", r"^src/main/java/.*\.java$", r"@SpringBootApplication", 20),
    ("ASP.NET Core", r"^(?:[^/]+/){0,2}[^/]+\.(?:cs|fs|vb)proj$", r"(?i)Microsoft\.AspNetCore|Microsoft\.NET\.Sdk\.Web", 35), ("iOS", r"^[^/]+\.xcodeproj/", "", 35),
]
# Well-known directories of a project without a known framework, and what their files are.
GENERIC_MODULES = [("src", "other"), ("app", "controller"), ("lib", "other"), ("config", "config"), ("routes", "route"), ("controllers", "controller"), ("services", "service"), ("models", "model"), ("middleware", "middleware"), ("commands", "command"), ("jobs", "job")]
# What the lines of a module's files offer: kind, framework or none, pattern with the verb as group 1 and the path or name as group 2.
ENTRIES = [
    ("route", "Laravel", r"Route::(get|post|put|patch|delete|any|resource)\s*\(\s*['\"]([^'\"]+)"), ("route", "ThinkPHP", r"Route::(get|post|put|patch|delete|any|rule|resource)\s*\(\s*['\"]([^'\"]+)"), ("route", "Gin", r"\.(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|Any)\s*\(\s*\"([^\"]+)"),
    ("route", "Go-Zero", r"^\s*(get|post|put|delete|patch)\s+(/\S*)"), ("route", "Spring Boot", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?\"([^\"]+)"), ("route", "Flask", r"@\w+\.(route|get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)"),
    ("route", "FastAPI", r"@\w+\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]*)"), ("route", "Django", r"\b(path|re_path|url)\s*\(\s*r?['\"]([^'\"]*)"), ("route", "NestJS", r"@(Get|Post|Put|Delete|Patch|Controller)\s*\(\s*['\"]([^'\"]*)"),
    ("route", "Express", r"\.(get|post|put|patch|delete|use|all)\s*\(\s*['\"]([^'\"]+)"), ("route", "Vue", r"(path):\s*['\"]([^'\"]+)"), ("route", "Rails", r"^\s*(get|post|put|patch|delete|resources|resource|root)\s+['\":]([^'\",\s]+)"), ("route", "Sinatra", r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)"),
    ("route", "ASP.NET Core", r"\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\s*\(\s*\"([^\"]+)"), ("route", "Phoenix", r"^\s*(get|post|put|patch|delete|resources)\s+\"([^\"]+)"), ("route", "Ktor", r"\b(get|post|put|patch|delete)\s*\(\s*\"([^\"]+)"),
    ("route", "Symfony", r"#\[(Route)\s*\(\s*['\"]([^'\"]+)"), ("command", "Laravel", r"protected\s+\$(signature)\s*=\s*['\"]([^'\"\s{]+)"), ("table", "Laravel", r"protected\s+\$(table)\s*=\s*['\"]([^'\"]+)"), ("table", "Spring Boot", r"@(Table)\s*\(\s*name\s*=\s*\"([^\"]+)"), ("table", "ThinkPHP", r"protected\s+\$(name|table)\s*=\s*['\"]([^'\"]+)"),
]
#: Verbs that stand for any request.
ANY_VERBS = ["request", "any", "route", "use", "all", "path", "re_path", "url", "rule", "controller", "resource", "resources", "root"]
# The modules of frameworks in order: name, kind, directories.
_MODULES = {
    "Laravel": [("Controllers", "controller", ["app/Http/Controllers"]), ("Models", "model", ["app/Models"]), ("Services", "service", ["app/Services"]), ("Commands", "command", ["app/Console/Commands"]), ("Jobs", "job", ["app/Jobs"]), ("Middleware", "middleware", ["app/Http/Middleware"]), ("Config", "config", ["config"]), ("Migrations", "other", ["database/migrations"])],
    "Gin": [("Handlers", "controller", ["handler"]), ("Services", "service", ["service"]), ("Models", "model", ["model"]), ("Config", "config", ["config"]), ("Workers", "job", ["worker"]), ("Cron", "command", ["cron"])],
    "ThinkPHP": [("Controllers", "controller", ["app/controller"]), ("Models", "model", ["app/model"]), ("Services", "service", ["app/service"]), ("Middleware", "middleware", ["app/middleware"]), ("Configuration", "config", ["config"])],
    "Symfony": [("Controllers", "controller", ["src/Controller"]), ("Services", "service", ["src/Service"]), ("Entities", "model", ["src/Entity"]), ("Commands", "command", ["src/Command"]), ("Templates", "view", ["templates"])],
    "Go-Zero": [("Handlers", "controller", ["internal/handler"]), ("Logic", "service", ["internal/logic"]), ("Service Context", "service", ["internal/svc"]), ("Models", "model", ["internal/model", "model"]), ("Configuration", "config", ["etc"])],
    "Spring Boot": [("Controllers", "controller", ["src/main/java"]), ("Configuration", "config", ["src/main/resources"])],
    "FastAPI": [("Routers", "route", ["routers", "app/routers"]), ("Services", "service", ["services", "app/services"]), ("Models", "model", ["models", "schemas", "app/models", "app/schemas"]), ("Configuration", "config", ["config", "app/config"])],
    "NestJS": [("Controllers", "controller", ["src"]), ("Modules", "service", ["src/modules"]), ("Services", "service", ["src/services"]), ("Entities", "model", ["src/entities", "src/models"])],
    "Express": [("Routes", "route", ["routes", "src/routes"]), ("Controllers", "controller", ["controllers", "src/controllers"]), ("Services", "service", ["services", "src/services"]), ("Models", "model", ["models", "src/models"]), ("Middleware", "middleware", ["middleware", "src/middleware"])],
    "React": [("Pages", "view", ["src/pages", "src/views", "pages", "app"]), ("Components", "component", ["src/components", "components"]), ("Hooks", "util", ["src/hooks", "hooks"]), ("API", "util", ["src/api", "api"])],
    "Vue": [("Components", "component", ["src/components"]), ("Store", "store", ["src/store", "src/stores"]), ("Views", "view", ["src/views", "src/pages"]), ("API", "util", ["src/api"]), ("Utils", "util", ["src/utils"]), ("Layouts", "component", ["src/layouts"])],
    "Next.js": [("Pages", "view", ["pages", "app", "src/pages", "src/app"]), ("Components", "component", ["components", "src/components"]), ("API Routes", "route", ["pages/api", "app/api"])],
    "Electron": [("Main Process", "service", ["electron", "src/main", "main"]), ("Preload", "service", ["src/preload", "preload"]), ("Renderer", "view", ["src", "renderer"])],
    "Rails": [("Controllers", "controller", ["app/controllers"]), ("Models", "model", ["app/models"]), ("Services", "service", ["app/services"]), ("Jobs", "job", ["app/jobs"]), ("Views", "view", ["app/views"])],
    "Flutter": [("Dart Source", "view", ["lib"]), ("Tests", "other", ["test", "integration_test"])],
    "Phoenix": [("Web Layer", "controller", ["lib"]), ("Migrations", "migration", ["priv/repo/migrations"]), ("Configuration", "config", ["config"])],
    "Tauri": [("Rust Backend", "service", ["src-tauri/src"]), ("Configuration", "config", ["src-tauri"]), ("Frontend", "view", ["src", "app", "pages"])],
}
MODULES = [ModuleRule(framework, k, name, kind, d) for framework, rows in _MODULES.items() for k, (name, kind, directories) in enumerate(rows) for d in directories]

# Modules whose files have certain extensions: framework, name, kind, directories, extensions. ``*`` is any directory that holds such files.
ENDED_MODULES = [
    ("Django", "Views", "controller", ["*"], ".py"), ("Django", "Templates", "view", ["templates"], ".html"), ("Django", "Configuration", "config", ["config"], ".py .yaml .yml"), ("Flask", "Python Source", "service", ["*"], ".py"), ("Flask", "Templates", "view", ["templates"], ".html"),
    ("Angular", "App Modules", "component", ["src/app"], ".ts .html .scss .css"), ("Angular", "Components", "component", ["src/app", "src/components"], ".ts .html"), ("Angular", "Services", "service", ["src/app", "src/services"], ".ts"), ("Angular", "Routing", "route", ["src/app"], ".ts"), ("Angular", "Configuration", "config", ["src/environments"], ".ts .json"),
    ("Nuxt", "Pages", "view", ["pages", "src/pages"], ".vue .ts .js"), ("Nuxt", "Components", "component", ["components", "src/components"], ".vue .ts .js"), ("Nuxt", "Server Routes", "route", ["server/api", "server/routes"], ".ts .js"), ("Nuxt", "Composables", "util", ["composables", "src/composables"], ".ts .js"),
    ("SvelteKit", "Routes", "route", ["src/routes"], ".svelte .js .ts"), ("SvelteKit", "Library", "component", ["src/lib"], ".svelte .js .ts"), ("Sinatra", "Ruby Source", "service", ["*", "routes", "controllers", "services"], ".rb"), ("Sinatra", "Views", "view", ["views"], ".erb .haml .slim"),
    ("ASP.NET Core", "Controllers", "controller", ["Controllers", "src/Controllers"], ".cs .fs .vb"), ("ASP.NET Core", "Pages", "view", ["Pages", "Views"], ".cshtml .razor"), ("ASP.NET Core", "Models", "model", ["Models", "Data", "Entities"], ".cs .fs .vb"), ("ASP.NET Core", "Services", "service", ["Services"], ".cs .fs .vb"),
    ("Android", "Activities / Kotlin", "controller", ["app/src/main/kotlin"], ".kt .java"), ("Android", "Activities / Java", "controller", ["app/src/main/java"], ".java .kt"), ("Android", "Resources", "view", ["app/src/main/res"], ".xml"), ("Android", "Configuration", "config", ["app"], ".gradle .kts .xml"),
    ("iOS", "Swift Sources", "service", ["Sources", "ios", "App"], ".swift .m .mm"), ("iOS", "Resources", "view", ["Resources", "Assets.xcassets", "ios"], ".storyboard .xib .plist"), ("Ktor", "Kotlin Source", "service", ["src/main/kotlin"], ".kt .kts"),
    ("Flutter", "Android Shell", "config", ["android"], ".gradle .kt .java .xml"), ("Flutter", "iOS Shell", "config", ["ios"], ".swift .m .mm .plist .pbxproj"), ("Rails", "Configuration", "config", ["config"], ".rb .yml .yaml"), ("Phoenix", "Contexts", "service", ["lib"], ".ex"),
]
_numbers: dict[str, int] = {}
for _framework, _title, _kind, _dirs, _endings in ENDED_MODULES:
    _numbers[_framework] = _numbers.get(_framework, 9) + 1  # behind the modules above
    MODULES.extend(ModuleRule(_framework, _numbers[_framework], _title, _kind, d, _endings) for d in _dirs)
