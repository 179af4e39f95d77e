"""Queries on what source files declare, and their SQL, made of the same lines and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.operators import methods, structure
from custodia.plans import sql
from custodia.rules import structure as rules
from custodia.sources.tables import table


def _files(spark, d):
    return table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "file_language", "content")


def declared_symbols(spark, d):
    """Every declaration with its line, kind and name."""
    return structure.declarations(_files(spark, d)).select("file_id", "line_no", F.when((F.col("kind") == "method") & F.col("file_language").isin("Python", "PHP"), "function").otherwise(F.col("kind")).alias("kind"), "name")


def symbol_parents(spark, d):
    """Declarations of each kind and visibility that lie in a type, and those that do not."""
    declared = structure.declarations(_files(spark, d))
    return declared.groupBy("repo_id", "file_language", "kind", "visibility").agg(F.count(F.lit(1)).alias("symbols"), F.count("parent").alias("inside"), F.countDistinct("parent").alias("parents"))


def type_edges(spark, d):
    """What types extend and implement."""
    return structure.type_edges(structure.declarations(_files(spark, d)))


def import_lines(spark, d):
    """The imports of each file, one row for each imported name, with its first line."""
    return structure.imported(_files(spark, d)).select("file_id", "line_no", "import_path")


def call_names(spark, d):
    """How often each name is called, by the number of files."""
    calls = structure.called(_files(spark, d)).withColumn("callee", F.regexp_extract("call", r"([A-Za-z0-9_$]*)!?$", 1))
    return calls.groupBy("repo_id", "callee").agg(F.countDistinct("file_id").alias("files"))


def structure_totals(spark, d):
    """Totals of the analysis of each repository; files over 20,000 characters are skipped."""
    files = _files(spark, d)
    return structure.analysis(files, files.where(F.length("content") <= 20_000))


def source_methods(spark, d):
    """Methods of each file with visibility, parameters, first sentence, intent and what their bodies do."""
    found = methods.method_facts(methods.methods(_files(spark, d)))
    return found.select("file_id", "ordinal", "name", "visibility", "params", F.array_join("parameter_names", ",").alias("parameter_names"), "doc", "intent", "branches", "exits", F.array_join("notes", ",").alias("notes"), "body_chars")


def method_names(spark, d):
    """Names and parameters of the methods of each file."""
    return methods.methods(_files(spark, d)).select("file_id", "name", "params")


def file_facts(spark, d):
    """Namespace, first type, what it extends, and notes of each file."""
    return methods.file_facts(_files(spark, d))


_LINES = f"""{sql.SOURCES}, raw_lines AS (SELECT file_id, repo_id, file_path, file_language, unnest(string_split_regex(content, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line_no FROM sources),
lines AS (SELECT * FROM raw_lines WHERE NOT regexp_matches(line, {sql.quoted(rules.COMMENT_LINE)}))"""
_IN_DATA = ["Python", "JavaScript", "TypeScript", "Go", "Java", "PHP"]


def _of_first(value) -> str:
    return "CASE " + " ".join(f"WHEN file_language = '{r.language}' AND regexp_matches(line, {sql.quoted(r.pattern)}) THEN {value(r)}" for r in rules.RULES if r.language in _IN_DATA) + " END"


_SPOKEN = f"kind IN ('method', 'constructor') AND (name IN ({', '.join(map(sql.quoted, rules.NO_NAMES))}) OR regexp_matches(line, '^\\s*(?:return|throw|new|else|await|yield)\\b'))"
_DECLARED = f"declared AS (SELECT DISTINCT file_id, file_language, line_no, line, {_of_first(lambda r: sql.quoted(r.kind))} AS kind, {_of_first(lambda r: f'regexp_extract(line, {sql.quoted(r.pattern)}, 1)')} AS name FROM lines)"
_CALLS = f"""WITH {_LINES}, found AS (SELECT DISTINCT repo_id, file_id, unnest(regexp_extract_all(line, {sql.quoted(rules.CALL)}, 1)) AS call FROM lines WHERE file_language IN ({', '.join(map(sql.quoted, _IN_DATA))}) AND NOT regexp_matches(line, {sql.quoted(rules.DECLARES)}))
SELECT repo_id, regexp_extract(call, '([A-Za-z0-9_$]*)!?$', 1) AS callee, count(DISTINCT file_id) AS files FROM found WHERE call NOT IN ({', '.join(map(sql.quoted, rules.NO_CALLS))}) GROUP BY ALL"""
_METHODS = {".php": [(methods.PHP, 3, 4)], ".go": [(methods.GO, 2, 3)], ".java .kt": [(methods.JAVA, 3, 4)], ".ts .tsx .js .jsx .vue": [(p, 2, 3) for p in methods.SCRIPT]}
_FOUND = " UNION ALL ".join(
    f"SELECT file_id, file_path, unnest(regexp_extract_all(content, {sql.quoted(p)}, {n})) AS name, unnest(regexp_extract_all(content, {sql.quoted(p)}, {a})) AS raw FROM sources WHERE {sql.extension('file_path')} IN ({', '.join(map(sql.quoted, ends.split()))})" for ends, found in _METHODS.items() for p, n, a in found
)
_PARAMS = "trim(regexp_replace(raw, '\\s+', ' ', 'g'))"
_INCLUDED = "CASE WHEN suffix(lower(file_path), '.php') THEN NOT starts_with(name, '__') OR name = '__construct' ELSE NOT starts_with(name, '__') AND name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function', 'return') AND NOT (suffix(lower(file_path), '.go') AND name = 'init') END"

QUERIES = {
    "declared_symbols": (declared_symbols, f"WITH {_LINES}, {_DECLARED} SELECT file_id, line_no, kind, name FROM declared WHERE kind IS NOT NULL AND NOT ({_SPOKEN})"),
    "symbol_parents": (symbol_parents, None),
    "type_edges": (type_edges, None),
    "import_lines": (import_lines, None),
    "call_names": (call_names, _CALLS),
    "structure_totals": (structure_totals, None),
    "source_methods": (source_methods, None),
    "method_names": (method_names, f"WITH {sql.SOURCES}, found AS ({_FOUND}) SELECT DISTINCT file_id, name, CASE WHEN length({_PARAMS}) > 100 THEN {_PARAMS}[1:100] || '...' ELSE {_PARAMS} END AS params FROM found WHERE {_INCLUDED}"),
    "file_facts": (file_facts, None),
}
