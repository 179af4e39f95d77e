"""Column functions on text and source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that replace markup characters, the ampersand first.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
#: Names of annotations by request method.
METHODS = {"getmapping": "GET", "postmapping": "POST", "putmapping": "PUT", "deletemapping": "DELETE", "patchmapping": "PATCH", "requestmapping": "ANY", "any": "ANY", "all": "ANY"}
#: What a method's lower-case name says it does: words it holds, and names it is; the first that fits holds.
INTENTS = [
    ("list", ("list", "index", "search"), ()), ("read", ("detail", "get"), ("show",)), ("create", ("add", "create", "store"), ()), ("update", ("edit", "update", "save", "modify"), ()), ("delete", ("delete", "destroy", "remove"), ()),
    ("approve", ("approve", "examine", "audit"), ()), ("sign_in", ("login", "logout", "auth"), ()), ("check", ("validate", "check"), ()), ("import", ("import", "upload"), ()), ("export", ("export", "download"), ()), ("sync", ("sync", "pull", "fetch"), ()),
    ("command", (), ("handle",)), ("handle", ("handler",), ("handle",)), ("render", ("render", "mounted", "setup"), ()), ("route", ("route", "router"), ()), ("convert", ("format", "normalize", "parse", "transform"), ()), ("send", ("send", "request", "call"), ()),
]
#: What the body of a method does, in the order of the notes.
BODY_NOTES = {
    "branching": r"\b(if|switch|match)\b",
    "validation": r"(?i)(validate\s*\(|rules\s*\(|shouldbind\w*\s*\(|bindjson\s*\(|empty\s*\([^)]|isset\s*\([^)]|@valid|@validated|required)",
    "transaction": r"(?i)(transaction|commit\s*\(|rollback\s*\()",
    "data_access": r"(?i)((?:select|find|first|get|pluck|where|query)\s*\(|\b(?:repository|mapper|dao)\b|(?:->|::|\.)(?:insert|update|delete|save|create|upsert|firstorcreate|forcedelete)\s*\(|\bgorm\b|\bdb\.)",
    "dependencies": r"(?i)((?:redis|cache)(?:::|->|\.|\s)|(?:http|axios|fetch|curl|guzzle|resttemplate|webclient|grpc|client)(?:::|->|\.|\s|\()|(?:auth|permission|policy|gate|middleware|token|jwt|role)(?:::|->|\.|\s|\())",
    "async": r"(?i)(queue|dispatch\s*\(|job|chan\s|go\s+func|goroutine|waitgroup|async\s+|await\s+)",
    "exceptions": r"(?i)(try\s*\{|catch\s*\(|finally\s*\{|defer\s+|panic\s*\(|recover\s*\(|throw\s+)",
    "files": r"(?i)(excel|csv|upload|download|multipart|file)",
}
DETECTORS = BODY_NOTES
#: Route families in order; group 1 is the method and group 2 the path.
ROUTES = [r"Route::(get|post|put|patch|delete|any)\(['\"]([^'\"]+)['\"]", r"\.(GET|POST|PUT|PATCH|DELETE|Any)\(['\"]([^'\"]+)['\"]", r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(['\"]([^'\"]+)['\"]", r"@(route)\(['\"]([^'\"]+)['\"]"]


def html_escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def snippet(text: Column, most: int = 72) -> Column:
    """One line of at most ``most`` characters, and an ellipsis if it was cut."""
    line = F.trim(F.regexp_replace(F.replace(text, F.lit("`"), F.lit("'")), "[ \t\r\n]+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def logic_notes(text: Column, most: int = 8) -> Column:
    """Codes of what a piece of code does, in a fixed order, at most ``most``."""
    found = F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(code)) for code, pattern in DETECTORS.items())))
    return F.slice(found, 1, most)


def line_count(text: Column) -> Column:
    """Lines of a text, a last one without line end included; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + (~text.endswith("\n")).cast("int"))


def routes(text: Column) -> Column:
    """Distinct routes as ``METHOD path``, by family and place."""
    found = F.array().cast("array<string>")
    for pattern in ROUTES:
        methods, paths = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
        name = lambda m: F.when(F.lower(m).isin("route", "request", "any"), F.lit("ANY")).otherwise(F.upper(m))
        found = F.concat(found, F.zip_with(methods, paths, lambda m, p: F.concat_ws(" ", name(m), p)))
    return F.array_distinct(found)


def http_method(word: Column) -> Column:
    plain = F.lower(word)
    out = F.upper(word)
    for name, method in METHODS.items():
        out = F.when(plain == name, F.lit(method)).otherwise(out)
    return out


def method_intent(name: Column, path: Column | None = None) -> Column:
    """What a method does, by its name; ``handle`` in a folder of commands runs one."""
    path = F.lit("") if path is None else path
    plain = F.lower(name)
    out = F.lit("other")
    for code, words, names in reversed(INTENTS):
        fits = F.lit(False)
        for w in words:
            fits = fits | plain.contains(w)
        for n in names:
            fits = fits | (plain == n)
        out = F.when(fits & path.contains("/Commands/") if code == "command" else fits, F.lit(code)).otherwise(out)
    return out


def body_notes(body: Column, most: int = 8) -> Column:
    """Codes of what a method's body does, an entry first and a check last, at most ``most``; ``no_body`` where it was not found."""
    found = [F.when(body.rlike(pattern), F.lit(code)) for code, pattern in BODY_NOTES.items()]
    middle = F.array_compact(F.array(*found))
    last = F.when(F.size(middle) > 0, F.lit("check_paths")).otherwise(F.lit("check_callers"))
    return F.when(F.length(body) == 0, F.array(F.lit("no_body"))).otherwise(F.slice(F.concat(F.array(F.lit("entry")), middle, F.array(last)), 1, most))


def snippets(found: Column, most: int) -> Column:
    """The first ``most`` different pieces, each as one line."""
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: snippet(x)), lambda x: x != "")), 1, most)


def line_of(text: Column, most: int = 100) -> Column:
    """The first line that is not blank, cut to ``most`` characters and an ellipsis."""
    first = F.regexp_replace(F.regexp_extract(text, r"^\s*([^\r\n]*)", 1), r"\s+", " ")
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


#: Words that stand for a type and no parameter.
TYPE_WORDS = ["array", "bool", "boolean", "callable", "context", "float", "int", "integer", "mixed", "object", "request", "response", "string"]


def parameter_names(params: Column, most: int = 6) -> Column:
    """The names in a parameter list, at most ``most``: defaults, types and sigils cut off, words for types left out."""
    bare = F.transform(F.split(params, ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "(?s)=.*$", ""), "[{}\\[\\]]", " "), r"^\s*\.\.\.", ""), "(?s):.*$", "")))
    last = F.transform(bare, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"(\S*)$", 1), r"^[&*$@]+", ""), r"[?:].*$", ""), r"[^A-Za-z0-9_$]", ""))
    return F.slice(F.filter(last, lambda p: (p != "") & ~F.lower(p).isin(TYPE_WORDS)), 1, most)


def import_kind(path: Column) -> Column:
    return F.when(path.rlike(r"^\.{1,2}(/|$)"), "relative").when(path.rlike(r"^[A-Za-z_][A-Za-z0-9_]*([.:\\\\/][A-Za-z0-9_*]+)+$"), "module").otherwise("package")


def call_key(call: Column) -> Column:
    """The last name of a call, without what it is called on and without arguments."""
    return F.regexp_extract(F.regexp_replace(call, r"\(.*$", ""), r"([A-Za-z0-9_$]*)$", 1)


def confidence_percent(value: Column) -> Column:
    """A whole percentage; values up to 1 are fractions."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.when(value <= 1, value * 100).otherwise(value)))).cast("int")


def repository_name(url: Column) -> Column:
    """The folder name of a repository's address."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    name = F.regexp_replace(F.regexp_extract(bare, r"([^/:]*)$", 1), r"\.git$", "")
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), F.lit("")), F.lit("repository"))


def without_ansi(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", ""), "\r\n?", "\n"))


def clone_progress(line: Column) -> Column:
    """Stage and percentage of a progress line of a clone; each stage has its share of the whole."""
    done = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(line, r"(\d{1,3})%", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(0))
    shares = [("counting", "Counting objects", 5, 10), ("compressing", "Compressing objects", 10, 20), ("receiving", "Receiving objects", 20, 80), ("resolving", "Resolving deltas", 80, 95), ("checkout", "Updating files", 95, 100)]
    stage, percent = F.lit(None).cast("string"), F.lit(None).cast("int")
    for code, words, start, stop in reversed(shares):
        hit = line.contains(words)
        stage = F.when(hit, F.lit(code)).otherwise(stage)
        percent = F.when(hit, F.lit(start) + F.floor(done * (stop - start) / 100).cast("int")).otherwise(percent)
    return F.struct(stage.alias("stage"), percent.alias("percent"))


def _section_entries(content: Column, *headers: str) -> Column:
    """Entries of sections of a TOML text."""
    out = F.lit(0)
    for header in headers:
        body = F.regexp_extract(content, rf"(?ms)^\[{header}\][ \t\r]*$(.*?)(?=^\[|\z)", 1)
        out = out + F.regexp_count(body, F.lit(r"(?m)^[ \t]*[A-Za-z0-9_.-]+[ \t]*="))
    return out


def manifest_facts(content: Column, name: Column) -> Column:
    """Ecosystem, dependencies, dependencies of development and manager of a manifest; null for other files and broken ones.

    What is declared is counted, once each: a block of ``go.mod`` by its entries, ``pubspec.yaml`` by the packages below its two keys.
    """
    plain = F.lower(name)
    keys = lambda field: F.coalesce(F.size(F.json_object_keys(F.get_json_object(content, f"$['{field}']"))), F.lit(0))
    counted = lambda pattern, text=None: F.regexp_count(content if text is None else text, F.lit(pattern))
    whole = F.json_object_keys(content).isNotNull()
    lines = counted(r"(?m)^[ \t]*[^#\s].*$")
    block = F.regexp_extract(content, r"(?s)\brequire\s*\((.*?)\)", 1)
    go = counted(r"(?m)^[ \t]*[^/\s]\S*[ \t]+v\S+", block) + counted(r"(?m)^[ \t]*require[ \t]+[^(\s]\S*[ \t]+\S+")
    listed = F.regexp_extract(content, r"(?ms)^\s*dependencies\s*=\s*\[(.*?)^?\s*\]", 1)
    items = F.size(F.filter(F.split(listed, ","), lambda x: (F.trim(F.regexp_replace(x, r"\s", "")) != "") & ~F.ltrim(x).startswith("#")))
    pub = lambda key: counted(r"(?m)^  [A-Za-z_][A-Za-z0-9_-]*:", F.regexp_extract(content, rf"(?ms)^{key}:[ \t\r]*$(.*?)(?=^\S|\z)", 1))
    none = F.lit(None).cast("int")
    rows = [
        ((plain == "package.json") & whole, "Node.js", keys("dependencies"), keys("devDependencies"), None), ((plain == "composer.json") & whole, "PHP Composer", keys("require"), keys("require-dev"), "composer"), (plain == "go.mod", "Go Modules", go, none, "go"),
        (plain == "pom.xml", "Java Maven", counted("<dependency>"), none, "maven"), (plain.isin("build.gradle", "build.gradle.kts"), "Java Gradle", counted(r"\b(?:api|implementation|compileOnly|runtimeOnly|testImplementation)\s*\(?"), none, "gradle"),
        (plain == "requirements.txt", "Python pip", lines, none, "pip"), (plain == "pyproject.toml", "Python pyproject", items + _section_entries(content, r"project\.dependencies", r"tool\.poetry\.dependencies"), none, "python"),
        (plain == "pipfile", "Python Pipenv", _section_entries(content, "packages"), _section_entries(content, "dev-packages"), "pipenv"), (plain == "gemfile", "Ruby Bundler", counted(r"(?m)^\s*gem\s+['\"]"), none, "bundler"),
        (plain == "cargo.toml", "Rust Cargo", _section_entries(content, "dependencies"), _section_entries(content, "dev-dependencies"), "cargo"), (plain == "pubspec.yaml", "Dart / Flutter pub", pub("dependencies"), pub("dev_dependencies"), "flutter"),
        (plain == "mix.exs", "Elixir Mix", counted(r"\{:\w+"), none, "mix"), (plain == "package.swift", "Swift Package Manager", counted(r"\.package\s*\("), none, "swift"), (plain == "podfile", "iOS CocoaPods", counted(r"(?m)^\s*pod\s+['\"]"), none, "cocoapods"),
        (plain.rlike(r"\.(cs|fs|vb)proj$"), ".NET NuGet", counted(r"<PackageReference\b"), none, "dotnet"),
    ]
    out = F.lit(None).cast("struct<ecosystem:string,dependencies:int,dev_dependencies:int,manager:string>")
    for fits, ecosystem, main, dev, manager in reversed(rows):
        out = F.when(fits & content.isNotNull(), F.struct(F.lit(ecosystem).alias("ecosystem"), main.cast("int").alias("dependencies"), dev.cast("int").alias("dev_dependencies"), F.lit(manager).cast("string").alias("manager"))).otherwise(out)
    return out


def dependency_count(content: Column, name: Column) -> Column:
    """Dependencies that a manifest declares, 0 for a broken one, null for other files."""
    json = F.lower(name).isin("package.json", "composer.json")
    return F.coalesce(manifest_facts(content, name)["dependencies"], F.when(json, F.lit(0)))
