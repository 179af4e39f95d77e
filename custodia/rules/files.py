"""Rules on paths."""

from __future__ import annotations

# Directories that are not descended, extensions that are not text, markers of modules.
IGNORED_DIRECTORIES = ".git node_modules vendor storage runtime dist build target .idea .vscode public assets __pycache__ .gradle .mvn cache tmp temp .next .nuxt coverage .vite vendor/bundle".split()
BINARY_EXTENSIONS = ".png .jpg .jpeg .gif .bmp .ico .webp .svg .pdf .zip .gz .tar .7z .rar .exe .dll .so .dylib .bin .jar .war .class .woff .woff2 .ttf .eot .mp3 .mp4 .avi .mov .wav .otf .ear .pyc .pyo .node".split()
MODULE_MARKERS = [
    ["Controllers", "controllers", "controller", "handlers", "handler"],
    ["Services", "Service", "services", "service"],
    ["Models", "models", "model", "entity", "entities"],
    ["Commands", "commands", "command", "jobs", "Jobs"],
]
MANIFESTS = "package.json composer.json go.mod pom.xml build.gradle build.gradle.kts requirements.txt pyproject.toml pipfile gemfile cargo.toml pubspec.yaml mix.exs package.swift podfile".split()
MANIFEST_EXTENSIONS = [".csproj", ".fsproj", ".vbproj"]
EXCLUDED_SOURCE = ["vendor/", "node_modules/", "storage/logs/", ".git/", "dist/", "build/"]
#: Extensions tried in order for a relative import, each after the path itself and after an index file in it.
IMPORT_EXTENSIONS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".py", ".php", ".go", ".java", ".cs", ".rs", ".c", ".h", ".cpp", ".hpp", ".mts", ".cts"]
LARGEST_INVENTORY_FILE = 100 * 1024
