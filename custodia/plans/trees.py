"""Queries on the files of repositories, their frameworks and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.functions import paths
from custodia.operators import authors, frameworks, inventory, projects, scope
from custodia.plans import sql
from custodia.rules import files as rules
from custodia.rules.frameworks import INDICATORS, MODULES, REGISTRY, THRESHOLDS
from custodia.sources.tables import table


def _inventory(spark, d):
    return inventory.inventory(table(spark, d, "source_files"))


def _files(spark, d):
    return authors.files_once(table(spark, d, "changed_files"))


def language_histogram(spark, d):
    return inventory.language_histogram(_inventory(spark, d))


def raised_histogram(spark, d):
    return inventory.raised_histogram(_inventory(spark, d), _files(spark, d))


def history_languages(spark, d):
    """Changed files by the language that the shorter map of histories gives."""
    return _files(spark, d).groupBy(paths.history_language(F.col("file_path")).alias("language")).agg(F.countDistinct("repo_id", "file_path").alias("file_count"))


def module_names(spark, d):
    return _files(spark, d).groupBy("repo_id", paths.module_name(F.col("file_path")).alias("module")).agg(F.countDistinct("file_path").alias("file_count"))


def file_categories(spark, d):
    return _files(spark, d).select("repo_id", "file_path").distinct().groupBy(paths.category(F.col("file_path")).alias("category"), paths.extension(F.col("file_path")).alias("extension")).agg(F.count(F.lit(1)).alias("file_count"))


def top_level_dirs(spark, d):
    return inventory.top_directories(_inventory(spark, d))


def path_flags(spark, d):
    flagged = inventory.path_flags(_files(spark, d).select("repo_id", "file_path").distinct())
    return flagged.groupBy("repo_id").agg(*(F.sum(c).cast("long").alias(c) for c in flagged.columns[2:]))


def scanned_inventory(spark, d):
    """The files that an inventory holds, by language."""
    kept = inventory.scanned(_inventory(spark, d))
    return kept.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").cast("long").alias("size_bytes"))


def shallow_scan(spark, d):
    """Source files at most two directories below src."""
    return inventory.within(_inventory(spark, d), "src", [".ts", ".js", ".vue"], 2).select("repo_id", "file_path")


def _merged(spark, d, files):
    listed = table(spark, d, "modules").where("files is not null").select("repo_id", F.explode("files").alias("file_path")).distinct()
    merged = inventory.merged_inventory(files, listed)
    return merged.groupBy("repo_id", "origin", "language").agg(F.count(F.lit(1)).alias("file_count"), F.min("file_path").alias("first_path"))


def inventory_merge(spark, d):
    """The whole inventory with the listed files that it does not hold."""
    return _merged(spark, d, _inventory(spark, d))


def key_files(spark, d):
    return inventory.key_files(_inventory(spark, d))


def exists_flag(spark, d):
    changed = _files(spark, d).select("repo_id", "file_path").distinct()
    return inventory.with_existence(changed, _inventory(spark, d)).groupBy("repo_id", F.col("exists_now").cast("int").alias("exists_now")).agg(F.count(F.lit(1)).alias("file_count"))


def personal_scope(spark, d):
    own = scope.personal_files(_inventory(spark, d), _files(spark, d).where("coalesce(file_exists, true)"))
    return own.groupBy("repo_id", "author").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").cast("long").alias("size_bytes"), F.min("file_path").alias("first_path"))


def personal_modules(spark, d):
    return scope.personal_modules(table(spark, d, "modules"), _files(spark, d))


def author_hints(spark, d):
    return projects.author_hints(authors.with_risk(_files(spark, d)))


def project_commands(spark, d):
    """Start commands that the files of each repository imply or its manifests declare."""
    return projects.start_commands(table(spark, d, "source_files").select("repo_id", "file_path", "content"))


def manifest_counts(spark, d):
    """What the manifests of each repository declare."""
    files = table(spark, d, "source_files").select("repo_id", "file_path", "content")
    return projects.manifests(files).select("repo_id", "file_path", "ecosystem", "dependencies", "dev_dependencies", "manager")


def generic_modules(spark, d):
    """Modules of the repositories in which no framework gives any."""
    files = table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content")
    found = frameworks.module_files(files, frameworks.framework_scores(files))
    return frameworks.generic_modules(files.select("repo_id", "file_path"), found).groupBy("repo_id", "ordinal", "name", "kind").agg(F.count(F.lit(1)).alias("file_count"))


def module_entries(spark, d):
    """Routes, commands and tables by the rules of each repository's first framework."""
    files = table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content")
    return frameworks.module_entries(files, frameworks.framework_scores(files))


def framework_score(spark, d):
    files = table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content")
    return frameworks.framework_scores(files)


def module_scan(spark, d):
    files = table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content")
    found = frameworks.module_files(files, frameworks.framework_scores(files))
    return found.groupBy("repo_id", "framework", "name", "kind").agg(F.count(F.lit(1)).alias("file_count"), F.min("file_path").alias("first_path"))


_CATEGORY = "CASE " + " ".join(f"WHEN {dict(contains='contains', startswith='prefix', endswith='suffix')[t]}(file_path, {sql.quoted(n)}) THEN '{c}'" for c, t, n in paths.CATEGORIES) + " ELSE 'other' END"
_NAME, _LOW = f"lower({sql.name('file_path')})", "lower(file_path)"
_SENSITIVE = f"((regexp_matches({_NAME}, '^\\.env(\\..+)?$') AND NOT regexp_matches({_NAME}, '\\.(example|sample|template|dist)$')) OR regexp_matches({_NAME}, '^(id_rsa|id_ed25519|credentials?|secrets?)(\\.[^.]+)?$') OR regexp_matches({_NAME}, '\\.(pem|key|p12|pfx)$'))"
_IGNORED = f"list_has_any(string_split({sql.directory('file_path')}, '/'), [{', '.join(map(sql.quoted, rules.IGNORED_DIRECTORIES))}])"
_BINARY = f"{sql.extension('file_path')} IN ({', '.join(map(sql.quoted, rules.BINARY_EXTENSIONS))})"
_FLAGS = {
    "sensitive": _SENSITIVE,
    "config": f"regexp_matches({_LOW}, '(^|/)config/|\\.(ya?ml|toml|ini|conf|cfg|properties)$')",
    "document": f"regexp_matches({_LOW}, '(^|/)docs?/|\\.(md|mdx|rst|adoc)$')",
    "readme": f"regexp_matches({_NAME}, '^readme(\\.|$)')",
    "manifest": f"({_NAME} IN ({', '.join(map(sql.quoted, rules.MANIFESTS))}) OR {sql.extension('file_path')} IN ({', '.join(map(sql.quoted, rules.MANIFEST_EXTENSIONS))}))",
    "critical": f"regexp_matches({_LOW}, '(auth|payment|order|billing|permission|security|migration|config|routes?/)')",
    "ignored": _IGNORED,
    "source": "(NOT suffix(file_path, '.lock')" + "".join(f" AND NOT contains(file_path, {sql.quoted(x)})" for x in rules.EXCLUDED_SOURCE) + ")",
}
_HINTS = {
    "risky_files": "risk = 'high'", "migrations": "contains(file_path, 'migrations/')", "configuration": _FLAGS["config"], "routes": "prefix(file_path, 'routes/') OR contains(file_path, 'router')",
    "background_jobs": f"contains({_LOW}, 'jobs/') OR contains({_LOW}, 'commands/')", "deleted_files": "status = 'deleted'", "renamed_files": "status = 'renamed'",
}
_RULES = ", ".join(f"({sql.quoted(i.framework)}, {REGISTRY.index(i.framework)}, {i.ordinal}, {sql.quoted(i.path)}, [{', '.join(map(sql.quoted, i.needles))}]::VARCHAR[], {i.weight}, {THRESHOLDS[i.framework]})" for i in INDICATORS)
_MODULES = ", ".join(f"({sql.quoted(m.framework)}, {m.ordinal}, {sql.quoted(m.name)}, {sql.quoted(m.kind)}, {sql.quoted(m.directory)}, {sql.quoted(m.endings)})" for m in MODULES)
_SCORES = f"""{sql.SOURCES}, rules(framework, registry, ordinal, path, needles, weight, threshold) AS (VALUES {_RULES}),
parts AS (SELECT DISTINCT repo_id, string_split({sql.directory('file_path')}, '/') AS p FROM sources WHERE contains(file_path, '/')),
folders AS (SELECT DISTINCT repo_id, list_aggregate(p[1:n], 'string_agg', '/') || '/' AS path FROM (SELECT repo_id, p, unnest(range(1, len(p) + 1)) AS n FROM parts)),
met AS (SELECT DISTINCT repo_id, framework, registry, ordinal, path, weight, threshold FROM folders JOIN rules USING (path)
 UNION SELECT DISTINCT s.repo_id, framework, registry, ordinal, path, weight, threshold FROM sources s JOIN rules r ON s.file_path = r.path WHERE NOT suffix(path, '/') AND (len(needles) = 0 OR len(list_filter(needles, lambda x: contains(coalesce(s.content, ''), x))) > 0)),
scored AS (SELECT repo_id, framework, registry, least(sum(weight), 100)::BIGINT AS confidence, string_agg(path, '|' ORDER BY ordinal, path) AS evidence FROM met GROUP BY repo_id, framework, registry, threshold HAVING sum(weight) >= threshold),
frameworks AS (SELECT repo_id, framework, confidence, evidence, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, registry) AS place FROM scored)"""

QUERIES = {
    "manifest_counts": (manifest_counts, None),
    "generic_modules": (generic_modules, None),
    "module_entries": (module_entries, None),
    "language_histogram": (language_histogram, f"""WITH {sql.INVENTORY}, counts AS (SELECT repo_id, language, count(*) AS file_count, string_agg(DISTINCT CASE WHEN extension = '' THEN name ELSE extension END, ',' ORDER BY CASE WHEN extension = '' THEN name ELSE extension END) AS extensions FROM inventory WHERE language IS NOT NULL GROUP BY ALL)
SELECT *, file_count::DOUBLE * 100::DOUBLE / (sum(file_count) OVER (PARTITION BY repo_id))::DOUBLE AS percentage FROM counts"""),
    "raised_histogram": (raised_histogram, f"""WITH {sql.INVENTORY}, {sql.FILES}, held AS (SELECT repo_id, language, count(*) AS n FROM inventory WHERE language IS NOT NULL GROUP BY ALL), used AS (SELECT DISTINCT repo_id, file_language AS language FROM files_once WHERE file_language IS NOT NULL)
SELECT coalesce(h.repo_id, u.repo_id) AS repo_id, coalesce(h.language, u.language) AS language, greatest(coalesce(n, 0), CASE WHEN u.language IS NULL THEN 0 ELSE 1 END)::BIGINT AS file_count FROM held h FULL JOIN used u ON h.repo_id = u.repo_id AND h.language = u.language"""),
    "history_languages": (history_languages, f"WITH {sql.FILES} SELECT {sql.history_language('file_path')} AS language, count(DISTINCT (repo_id, file_path)) AS file_count FROM files_once GROUP BY ALL"),
    "module_names": (module_names, f"WITH {sql.FILES} SELECT repo_id, {sql.module_name('file_path')} AS module, count(DISTINCT file_path) AS file_count FROM files_once GROUP BY ALL"),
    "file_categories": (file_categories, f"WITH {sql.FILES}, named AS (SELECT DISTINCT repo_id, file_path FROM files_once) SELECT {_CATEGORY} AS category, {sql.extension('file_path')} AS extension, count(*) AS file_count FROM named GROUP BY ALL"),
    "top_level_dirs": (top_level_dirs, f"WITH {sql.INVENTORY}, counts AS (SELECT repo_id, string_split(file_path, '/')[1] AS directory, count(*) AS file_count FROM inventory WHERE contains(file_path, '/') GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, directory) AS place FROM counts) SELECT * FROM ranked WHERE place <= 50"),
    "path_flags": (path_flags, f"WITH {sql.FILES}, named AS (SELECT DISTINCT repo_id, file_path FROM files_once) SELECT repo_id, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _FLAGS.items()) + " FROM named GROUP BY ALL"),
    "scanned_inventory": (scanned_inventory, f"WITH {sql.INVENTORY} SELECT repo_id, language, count(*) AS file_count, sum(size_bytes)::BIGINT AS size_bytes FROM inventory WHERE NOT {_BINARY} AND NOT {_IGNORED} AND NOT {_SENSITIVE} AND coalesce(size_bytes, 0) <= {rules.LARGEST_INVENTORY_FILE} GROUP BY ALL"),
    "shallow_scan": (shallow_scan, f"WITH {sql.INVENTORY} SELECT repo_id, file_path FROM inventory WHERE prefix(file_path, 'src/') AND len(string_split(file_path, '/')) - 2 <= 2 AND extension IN ('.ts', '.js', '.vue')"),
    "inventory_merge": (inventory_merge, f"""WITH {sql.INVENTORY}, listed AS (SELECT DISTINCT repo_id, unnest(files) AS file_path FROM modules), firsts AS (SELECT repo_id, lower(file_path) AS low, min(file_path) AS file_path FROM listed GROUP BY ALL),
merged AS (SELECT repo_id, file_path, coalesce(language, 'Unknown') AS language, 'scanned' AS origin FROM inventory UNION ALL SELECT repo_id, file_path, 'Unknown', 'added' FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM inventory s WHERE s.repo_id = f.repo_id AND lower(s.file_path) = f.low))
SELECT repo_id, origin, language, count(*) AS file_count, min(file_path) AS first_path FROM merged GROUP BY ALL"""),
    "key_files": (key_files, f"""WITH {sql.INVENTORY}, ranked AS (SELECT *, {sql.directory('file_path')} AS directory, row_number() OVER (PARTITION BY repo_id, {sql.directory('file_path')} ORDER BY size_bytes DESC, file_path) AS rank FROM inventory),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY directory, rank) AS place FROM ranked WHERE rank <= 5) SELECT repo_id, place, directory, rank, file_path, size_bytes FROM placed WHERE place <= 50"""),
    "exists_flag": (exists_flag, f"WITH {sql.FILES}, {sql.INVENTORY}, named AS (SELECT DISTINCT repo_id, file_path FROM files_once), held AS (SELECT DISTINCT repo_id, file_path, 1 AS held FROM inventory) SELECT repo_id, coalesce(held, 0)::BIGINT AS exists_now, count(*) AS file_count FROM named LEFT JOIN held USING (repo_id, file_path) GROUP BY ALL"),
    "personal_scope": (personal_scope, f"WITH {sql.FILES}, {sql.INVENTORY}, touched AS (SELECT DISTINCT repo_id, author, file_path FROM files_once WHERE author IS NOT NULL AND coalesce(file_exists, true)) SELECT repo_id, author, count(*) AS file_count, sum(size_bytes)::BIGINT AS size_bytes, min(file_path) AS first_path FROM inventory JOIN touched USING (repo_id, file_path) GROUP BY ALL"),
    "personal_modules": (personal_modules, f"""WITH {sql.FILES}, touched AS (SELECT DISTINCT repo_id, author, file_path FROM files_once WHERE author IS NOT NULL), listed AS (SELECT repo_id, ordinal, name, module_type, file_path, min(place) AS place FROM (SELECT repo_id, ordinal, name, module_type, unnest(files) AS file_path, generate_subscripts(files, 1) AS place FROM modules) GROUP BY ALL)
SELECT repo_id, author, ordinal, name, module_type, count(*) AS file_count, string_agg(file_path, '|' ORDER BY place) AS files FROM listed JOIN touched USING (repo_id, file_path) GROUP BY ALL"""),
    "author_hints": (author_hints, f"WITH {sql.RISK} SELECT repo_id, author, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or({t}) THEN '{n}' END" for n, t in _HINTS.items()) + ") AS hints FROM risked GROUP BY ALL"),
    "project_commands": (project_commands, None),
    "framework_score": (framework_score, f"WITH {_SCORES} SELECT repo_id, framework, confidence, evidence, place FROM frameworks"),
    "module_scan": (module_scan, f"""WITH {_SCORES}, module_rules(framework, ordinal, name, kind, directory, endings) AS (VALUES {_MODULES}), placed AS (SELECT DISTINCT repo_id, file_path, '*' AS directory FROM sources UNION SELECT DISTINCT repo_id, file_path, list_aggregate(p[1:n], 'string_agg', '/') AS directory FROM (SELECT repo_id, file_path, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT repo_id, file_path, string_split({sql.directory('file_path')}, '/') AS p FROM sources WHERE contains(file_path, '/')))),
found AS (SELECT DISTINCT repo_id, framework, ordinal, name, kind, file_path FROM placed JOIN frameworks USING (repo_id) JOIN module_rules USING (framework, directory) WHERE place = 1 AND (endings = '' OR list_contains(string_split(endings, ' '), {sql.extension('file_path')})))
SELECT repo_id, framework, name, kind, count(*) AS file_count, min(file_path) AS first_path FROM found GROUP BY ALL"""),
}
