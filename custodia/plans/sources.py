"""Queries on the text of sources and documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from custodia.functions import text
from custodia.functions.bodies import declared_bodies
from custodia.operators import relations, scope
from custodia.plans import sql
from custodia.rules.files import IMPORT_EXTENSIONS
from custodia.sources.tables import table


def _sources(spark, d):
    return relations.sources(table(spark, d, "source_files"))


def source_signals(spark, d):
    """Lines, branches and what else the code of each file shows."""
    hits = {name: text.occurrences(F.col("content"), pattern) for name, pattern in text.DETECTORS.items()}
    return _sources(spark, d).select("file_id", text.line_count(F.col("content")).alias("lines"), *(c.alias(n) for n, c in hits.items())).dropDuplicates(["file_id"])


def source_notes(spark, d):
    """What the code of each file does, as codes."""
    return _sources(spark, d).select("file_id", F.array_join(text.logic_notes(F.col("content")), ",").alias("notes")).dropDuplicates(["file_id"])


def function_bodies(spark, d):
    """Characters in the body of each function of the languages with braces, found from where its name is declared."""
    patterns = {k: v for k, v in relations.FUNCTIONS.items() if k != "Python"}

    def bodies(batches):
        for batch in batches:
            rows = [(repo, path, *found[1:]) for repo, path, language, content in zip(*(batch.column(k).to_pylist() for k in range(4))) for found in declared_bodies(content or "", patterns[language])]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.string(), pa.int64()])], ["repo_id", "file_path", "name", "chars"])

    files = _sources(spark, d).where(F.col("file_language").isin(list(patterns))).select("repo_id", "file_path", "file_language", "content")
    return files.mapInArrow(bodies, "repo_id string, file_path string, name string, chars long").distinct()


def source_routes(spark, d):
    return _sources(spark, d).select("repo_id", "file_path", F.posexplode(text.routes(F.col("content"))).alias("ordinal", "route")).distinct()


def function_intents(spark, d):
    declared = relations.symbols(_sources(spark, d)).where("kind = 'function'")
    return declared.groupBy("repo_id", text.method_intent(F.regexp_replace("name", "^_+", ""), F.col("file_path")).alias("intent")).agg(F.count(F.lit(1)).alias("functions"))


def symbol_counts(spark, d):
    return relations.symbols(_sources(spark, d)).groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("name").alias("names"))


def import_edges(spark, d):
    return relations.imports(_sources(spark, d)).select("repo_id", "file_path", "ordinal", "import_path", "kind")


def resolved_imports(spark, d):
    sources = _sources(spark, d)
    return relations.resolved_imports(relations.imports(sources), sources)


def unique_target_calls(spark, d):
    sources = _sources(spark, d)
    return relations.call_edges(relations.calls(sources), relations.symbols(sources))


def inheritance_edges(spark, d):
    return relations.inheritance(_sources(spark, d))


def relation_counts(spark, d):
    sources = _sources(spark, d)
    return relations.relation_counts(relations.imports(sources), relations.calls(sources), relations.inheritance(sources))


def analysis_totals(spark, d):
    return relations.analysis_totals(table(spark, d, "ast_files"))


def html_escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", text.html_escape(F.col("text")).alias("html"))


def document_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.line_count(F.col("text")).alias("lines"))


def clean_documents(spark, d):
    """Documents with uniform line ends and without escapes of terminals."""
    return table(spark, d, "documents").select("doc_id", F.length(text.without_ansi(F.col("text"))).alias("chars"))


def property_counts(spark, d):
    """Keys of the JSON properties of events, counted as a manifest's dependencies are."""
    return table(spark, d, "events").groupBy("event_type", F.coalesce(F.size(F.json_object_keys("props")), F.lit(0)).alias("keys")).agg(F.count(F.lit(1)).alias("events"))


def union_precedence(spark, d):
    """Routes of modules and of sources; a route that a module lists is not taken from the sources."""
    listed = table(spark, d, "modules").where("routes is not null").select("repo_id", F.explode("routes").alias("route"), F.col("name").alias("found_in"))
    seen = _sources(spark, d).select("repo_id", F.explode(text.routes(F.col("content"))).alias("route"), F.col("file_path").alias("found_in"))
    return scope.first_wins([listed, seen], ["repo_id", "route"], [F.col("found_in")])


def recent_upsert(spark, d):
    """The twenty newest projects after the hand-over documents have replaced what was held."""
    documents = table(spark, d, "documents").select("doc_id", "repo_id", "source", "created_at").where("repo_id is not null")
    newest = lambda df: df.groupBy("repo_id").agg(F.max(F.struct("created_at", "doc_id")).alias("m")).select("repo_id", "m.created_at", "m.doc_id")
    merged = scope.upserted(newest(documents.where("source <> 'handover'")), newest(documents.where("source = 'handover'")), "repo_id", "created_at")
    return merged.select("repo_id", "doc_id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"))


def search_paginate(spark, d):
    """The second page of the repositories whose name or language contains a word."""
    files = table(spark, d, "source_files").select("repo_id", "file_language").distinct()
    hits = files.where(F.lower("repo_id").contains("a") & F.lower("file_language").contains("script"))
    return hits.orderBy("repo_id", "file_language").offset(20).limit(20)


def project_figures(spark, d):
    documents = table(spark, d, "documents")
    return documents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("source") == "handover").alias("handovers"), F.countDistinct("lang").alias("languages"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"))




def _routes_sql(content: str) -> str:
    parts = []
    for pattern in text.ROUTES:
        p = sql.quoted(pattern)
        parts.append(f"list_transform(list_zip(regexp_extract_all({content}, {p}, 1), regexp_extract_all({content}, {p}, 2)), lambda z: CASE WHEN lower(z[1]) IN ('route', 'request', 'any') THEN 'ANY' ELSE upper(z[1]) END || ' ' || z[2])")
    return "list_concat(" + ", ".join(parts) + ")"


def _each(table: dict[str, str]) -> str:
    return "CASE file_language " + " ".join(f"WHEN '{k}' THEN regexp_extract_all(content, {sql.quoted(v)}, 1)" for k, v in table.items()) + " END"


def _ordered(name: str, source: str, what: str, column: str) -> str:
    """Distinct elements of a list with the place of their first mention among the distinct ones."""
    return f"""{name}_raw AS (SELECT repo_id, file_path, unnest(l) AS {column}, generate_subscripts(l, 1) AS spot FROM (SELECT repo_id, file_path, {what} AS l FROM {source})),
{name} AS (SELECT repo_id, file_path, {column}, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY min(spot)) - 1 AS ordinal FROM {name}_raw GROUP BY repo_id, file_path, {column})"""


_KIND = r"CASE WHEN regexp_matches(import_path, '^\.{1,2}(/|$)') THEN 'relative' WHEN regexp_matches(import_path, '^[A-Za-z_][A-Za-z0-9_]*([.:\\/][A-Za-z0-9_*]+)+$') THEN 'module' ELSE 'package' END"
_IMPORTS = _ordered("imports", "sources", _each(relations.IMPORTS), "import_path")
_FUNCTIONS = _ordered("functions", "sources", _each(relations.FUNCTIONS), "name")
_TYPES = _ordered("types", "sources", f"regexp_extract_all(content, {sql.quoted(relations.TYPES)}, 1)", "name")
_CALLS = _ordered("calls", "sources", f"regexp_extract_all(content, {sql.quoted(relations.CALLS)}, 1)", "call")
_BASES = _ordered("bases", "sources", f"regexp_extract_all(content, {sql.quoted(relations.BASES)}, 1)", "base")
_PLAIN = "lower(regexp_replace(name, '^_+', ''))"
_INTENT = "CASE " + " ".join("WHEN " + ("contains(file_path, '/Commands/') AND " if code == "command" else "") + "(" + " OR ".join([f"contains({_PLAIN}, '{w}')" for w in words] + [f"{_PLAIN} = '{n}'" for n in names]) + f") THEN '{code}'" for code, words, names in text.INTENTS) + " ELSE 'other' END"
_ESCAPED = "text"
for _plain, _entity in text.ENTITIES:
    _ESCAPED = f"replace({_ESCAPED}, {sql.quoted(_plain)}, {sql.quoted(_entity)})"
_LINES = "CASE WHEN length({0}) = 0 THEN 0 ELSE length({0}) - length(replace({0}, chr(10), '')) + (NOT suffix({0}, chr(10)))::INT END::BIGINT"
_LINE = "trim(regexp_replace(replace(text, '`', ''''), '[ \\t\\r\\n]+', ' ', 'g'))"

_DIR = sql.directory("file_path")
_UP = "'/' || {d} || '/' || import_path".format(d=_DIR)
_BASE = f"regexp_replace({_UP}, '(/\\.)+(/|$)', '/', 'g')"
for _ in range(6):  # one step up for each pair of dots
    _BASE = f"regexp_replace({_BASE}, '/[^/]+/\\.\\.(/|$)', '/')"
_BASE = f"regexp_replace(regexp_replace({_BASE}, '/+', '/', 'g'), '^/|/$', '', 'g')"
_SUFFIXES = [x for e in IMPORT_EXTENSIONS for x in ((e,) if e == "" else (e, f"/index{e}"))]
_RESOLVED = f"""WITH {sql.SOURCES}, {_IMPORTS}, wanted AS (SELECT DISTINCT repo_id, file_path, import_path, {_BASE} AS base FROM imports WHERE {_KIND} = 'relative'),
suffixes AS (SELECT unnest([{', '.join(sql.quoted(x) for x in _SUFFIXES)}]) AS suffix, generate_subscripts([{', '.join(sql.quoted(x) for x in _SUFFIXES)}], 1) AS place),
held AS (SELECT repo_id, lower(file_path) AS low, min(file_path) AS to_file FROM sources GROUP BY ALL),
found AS (SELECT w.repo_id, w.file_path, w.import_path, arg_min(h.to_file, s.place) AS to_file FROM wanted w CROSS JOIN suffixes s JOIN held h ON h.repo_id = w.repo_id AND h.low = lower(w.base || s.suffix) GROUP BY ALL)
SELECT w.repo_id, w.file_path, w.import_path, to_file FROM wanted w LEFT JOIN found USING (repo_id, file_path, import_path) WHERE NOT contains(base, '..')"""

QUERIES = {
    "source_signals": (source_signals, f"WITH {sql.SOURCES} SELECT file_id, {_LINES.format('content')} AS lines, " + ", ".join(f"len(regexp_extract_all(content, {sql.quoted(p)}))::BIGINT AS {n}" for n, p in text.DETECTORS.items()) + " FROM sources"),
    "source_notes": (source_notes, f"WITH {sql.SOURCES} SELECT file_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(content, {sql.quoted(p)}) THEN '{n}' END" for n, p in text.DETECTORS.items()) + ") AS notes FROM sources"),
    "function_bodies": (function_bodies, None),
    "source_routes": (source_routes, f"WITH {sql.SOURCES}, {_ordered('routes', 'sources', _routes_sql('content'), 'route')} SELECT repo_id, file_path, ordinal, route FROM routes"),
    "function_intents": (function_intents, f"WITH {sql.SOURCES}, {_FUNCTIONS} SELECT repo_id, {_INTENT} AS intent, count(*) AS functions FROM functions GROUP BY ALL"),
    "symbol_counts": (symbol_counts, f"WITH {sql.SOURCES}, {_FUNCTIONS}, {_TYPES} SELECT repo_id, kind, count(*) AS symbols, count(DISTINCT name) AS names FROM (SELECT *, 'function' AS kind FROM functions UNION ALL SELECT *, 'class' FROM types) GROUP BY ALL"),
    "import_edges": (import_edges, f"WITH {sql.SOURCES}, {_IMPORTS} SELECT repo_id, file_path, ordinal, import_path, {_KIND} AS kind FROM imports"),
    "resolved_imports": (resolved_imports, _RESOLVED),
    "unique_target_calls": (unique_target_calls, f"""WITH {sql.SOURCES}, {_FUNCTIONS}, {_CALLS}, targets AS (SELECT repo_id, lower(name) AS low, min(file_path) AS to_file FROM functions GROUP BY ALL HAVING count(DISTINCT file_path) = 1)
SELECT calls.repo_id, file_path, call, to_file FROM calls LEFT JOIN targets ON calls.repo_id = targets.repo_id AND lower(call) = low"""),
    "inheritance_edges": (inheritance_edges, f"WITH {sql.SOURCES}, {_BASES} SELECT repo_id, file_path, base FROM bases"),
    "relation_counts": (relation_counts, f"WITH {sql.SOURCES}, {_IMPORTS}, {_CALLS}, {_BASES} SELECT repo_id, kind, count(*) AS edges FROM (SELECT repo_id, 'import' AS kind FROM imports UNION ALL SELECT repo_id, 'call' FROM calls UNION ALL SELECT repo_id, 'inheritance' FROM bases) GROUP BY ALL"),
    "analysis_totals": (analysis_totals, "WITH once AS (SELECT DISTINCT * FROM ast_files) SELECT repo_id, count(*) AS files, coalesce(sum(symbol_count), 0)::BIGINT AS symbols, count(DISTINCT lower(trim(file_language))) AS languages, max((engine = 'static-fallback')::INT)::BIGINT AS fallback FROM once GROUP BY ALL"),
    "html_escaped": (html_escaped, f"SELECT doc_id, {_ESCAPED} AS html FROM documents"),
    "document_snippets": (document_snippets, f"SELECT doc_id, CASE WHEN length({_LINE}) > 72 THEN {_LINE}[1:72] || '...' ELSE {_LINE} END AS snippet, {_LINES.format('text')} AS lines FROM documents"),
    "clean_documents": (clean_documents, "SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '\x1b\\[[0-9;?]*[A-Za-z]', '', 'g'), '\\r\\n?', chr(10), 'g'))) AS chars FROM documents"),
    "property_counts": (property_counts, "SELECT event_type, coalesce(len(json_keys(props)), 0)::BIGINT AS keys, count(*) AS events FROM events GROUP BY ALL"),
    "union_precedence": (union_precedence, f"""WITH {sql.SOURCES}, joined AS (SELECT repo_id, unnest(routes) AS route, name AS found_in, 0 AS part FROM modules UNION ALL SELECT repo_id, unnest({_routes_sql('content')}), file_path, 1 FROM sources),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, route ORDER BY part, found_in) AS rank FROM joined) SELECT repo_id, route, found_in, part::BIGINT AS part FROM ranked WHERE rank = 1"""),
    "recent_upsert": (recent_upsert, """WITH newest AS (SELECT repo_id, source = 'handover' AS new, max((created_at, doc_id)) AS m FROM documents WHERE repo_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY new DESC) AS rank FROM newest) SELECT repo_id, (m[2])::BIGINT AS doc_id, strftime((m[1])::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS created FROM ranked WHERE rank = 1 ORDER BY m[1] DESC NULLS LAST, repo_id LIMIT 20"""),
    "search_paginate": (search_paginate, "WITH hits AS (SELECT DISTINCT repo_id, file_language FROM source_files WHERE contains(lower(repo_id), 'a') AND contains(lower(file_language), 'script')) SELECT repo_id, file_language FROM hits ORDER BY repo_id, file_language LIMIT 20 OFFSET 20"),
    "project_figures": (project_figures, "SELECT repo_id, count(*) AS documents, count(*) FILTER (source = 'handover') AS handovers, count(DISTINCT lang) AS languages, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY ALL"),
}
