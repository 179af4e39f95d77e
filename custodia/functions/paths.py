"""Column functions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custodia.rules import files, languages


def normal_path(path: Column) -> Column:
    """Slashes forward, none leading, no blanks around."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "^/+", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty for a name without one or a bare dot file."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.try_element_at(pairs, key)


def language(path: Column) -> Column:
    """The language of a path; file names come before extensions, null if neither is known."""
    name = F.lower(file_name(path))
    by_name, by_extension = _looked_up(languages.BY_NAME, name), _looked_up(languages.BY_EXTENSION, extension(path))
    apple = (extension(path) == ".m") & F.lower(path).rlike("(^|/)(ios|macos|objc)/")
    return F.when(name.endswith(".blade.php"), "Blade").when(apple, "Objective-C").otherwise(F.coalesce(by_name, by_extension))


def history_language(path: Column) -> Column:
    return F.coalesce(_looked_up(languages.HISTORY, extension(path)), F.lit("Unknown"))


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """The segment after the first marker, by category; else the first two segments."""
    parts = F.split(path, "/")
    found = F.lit(None).cast("string")
    for markers in reversed(files.MODULE_MARKERS):
        at = F.lit(None).cast("int")
        for marker in markers:
            at = F.least(at, F.nullif(F.array_position(parts, F.lit(marker)).cast("int"), F.lit(0)))
        after = F.try_element_at(parts, at + 1)
        found = F.when(at.isNotNull(), F.coalesce(F.nullif(_without_extension(after), F.lit("")), F.try_element_at(parts, at))).otherwise(found)
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    plain = F.when(second.isNotNull(), F.concat_ws("/", first, _without_extension(second))).otherwise(_without_extension(first))
    return F.coalesce(found, F.nullif(plain, F.lit("")), F.lit("Root"))


def business_area(path: Column) -> Column:
    """The area of a report to which a path belongs."""
    parts = F.split(path, "/")
    found = F.lit(None).cast("string")
    for marker in ("Commands", "Service", "Services", "Models", "Controllers"):
        at = F.nullif(F.array_position(parts, F.lit(marker)).cast("int"), F.lit(0))
        after = F.try_element_at(parts, at + 1)
        found = F.when(at.isNotNull(), F.when(after.isNull() | after.endswith(".php"), F.lit(marker)).otherwise(F.concat_ws("/", F.lit(marker), after))).otherwise(found)
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    root = F.when(first.isin("routes", "config", "database"), first)
    return F.coalesce(found, root, F.nullif(F.concat_ws("/", first, second), F.lit("")), F.lit("Other"))


# Codes of the kind of a file, in the order in which the tests are made.
CATEGORIES = [
    ("controller", "contains", "/Controllers/"), ("controller", "contains", "/controller/"), ("controller", "contains", "/controllers/"), ("controller", "contains", "/handler/"), ("controller", "contains", "/handlers/"),
    ("service", "contains", "/Services/"), ("service", "contains", "/Service/"), ("service", "contains", "/service/"), ("service", "contains", "/services/"),
    ("model", "contains", "/Models/"), ("model", "contains", "/model/"), ("model", "contains", "/models/"), ("model", "contains", "/entity/"), ("model", "contains", "/entities/"),
    ("artisan_command", "contains", "/Commands/"), ("command", "contains", "/command/"), ("command", "contains", "/commands/"), ("command", "contains", "/cron/"),
    ("job", "contains", "/Jobs/"), ("job", "contains", "/job/"), ("job", "contains", "/jobs/"), ("job", "contains", "/worker/"), ("job", "contains", "/consumer/"),
    ("middleware", "contains", "/Middleware/"), ("middleware", "contains", "/middleware/"), ("data_access", "contains", "/repository/"), ("data_access", "contains", "/repositories/"), ("data_access", "contains", "/mapper/"),
    ("component", "contains", "/component/"), ("component", "contains", "/components/"), ("page", "contains", "/view/"), ("page", "contains", "/views/"), ("page", "contains", "/page/"), ("page", "contains", "/pages/"),
    ("api", "contains", "/api/"), ("store", "contains", "/store/"), ("store", "contains", "/stores/"), ("utility", "contains", "/utils/"), ("utility", "contains", "/util/"), ("utility", "contains", "/composables/"),
    ("route", "startswith", "routes/"), ("route", "startswith", "router/"), ("config", "startswith", "config/"), ("config", "contains", "/config/"), ("migration", "startswith", "database/migrations/"), ("sql_script", "endswith", ".sql"),
]
#: What a file of each kind is responsible for; ``{}`` stands for its area.
DUTIES = {
    "controller": "takes requests of {} and directs the work", "service": "holds reusable logic of {}", "model": "maps the tables and queries of {}", "artisan_command": "runs commands and batches of {}", "command": "runs commands and batches of {}", "job": "works in the background for {}",
    "middleware": "checks and prepares requests of {}", "data_access": "stores and queries the data of {}", "component": "holds reusable interface parts of {}", "page": "shows the pages of {}", "api": "wraps the requests of {}", "store": "keeps shared state of {}", "utility": "offers tools to {}",
    "sql_script": "sets up or repairs the tables of {}", "route": "defines routes", "config": "configures the program and what it uses",
}


def category(path: Column) -> Column:
    out = F.lit("other")
    for code, test, needle in reversed(CATEGORIES):
        out = F.when(getattr(path, test)(needle), F.lit(code)).otherwise(out)
    return out


def responsibility(path: Column) -> Column:
    """What a file is responsible for, by its kind and area."""
    kind, area = category(path), business_area(path)
    out = F.concat(F.lit("belongs to "), area)
    for code, duty in DUTIES.items():
        before, _, after = duty.partition("{}")
        out = F.when(kind == code, F.concat(F.lit(before), area, F.lit(after)) if "{}" in duty else F.lit(duty)).otherwise(out)
    return out


def in_ignored_directory(path: Column) -> Column:
    return F.arrays_overlap(F.split(directory(path), "/"), F.array(*(F.lit(d) for d in files.IGNORED_DIRECTORIES)))


def is_binary(path: Column) -> Column:
    return extension(path).isin(files.BINARY_EXTENSIONS)


def is_sensitive(path: Column) -> Column:
    name = F.lower(file_name(path))
    env = name.rlike(r"^\.env(\..+)?$") & ~name.rlike(r"\.(example|sample|template|dist)$")
    return env | name.rlike(r"^(id_rsa|id_ed25519|credentials?|secrets?)(\.[^.]+)?$") | name.rlike(r"\.(pem|key|p12|pfx)$")


def is_manifest(path: Column) -> Column:
    return F.lower(file_name(path)).isin(files.MANIFESTS) | extension(path).isin(files.MANIFEST_EXTENSIONS)


def is_readme(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r"^readme(\.|$)")


def is_document(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)docs?/|\.(md|mdx|rst|adoc)$")


def is_config(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)config/|\.(ya?ml|toml|ini|conf|cfg|properties)$")


def is_critical(path: Column) -> Column:
    return F.lower(path).rlike("(auth|payment|order|billing|permission|security|migration|config|routes?/)")


def is_handover_source(path: Column) -> Column:
    out = ~path.endswith(".lock")
    for part in files.EXCLUDED_SOURCE:
        out = out & ~path.contains(part)
    return out


def top_directory(path: Column) -> Column:
    """The first segment, null for a file at the root."""
    return F.when(path.contains("/"), F.split(path, "/")[0])
