"""Queries that draw on several operators: documents of projects and persons, prompts, and their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from custodia.functions import paths
from custodia.functions.text import snippet
from custodia.operators import authors, frameworks, history, inventory, methods, overview, projects, relations, scope
from custodia.plans import histories, sql
from custodia.render import documents
from custodia.sources.tables import table


def _changed(spark, d):
    return authors.with_risk(authors.files_once(table(spark, d, "changed_files")))


def _inventory(spark, d):
    return inventory.inventory(table(spark, d, "source_files"))


def language_labels(spark, d):
    """Files by the label of their language."""
    return table(spark, d, "source_files").select("file_id", overview.language_label(F.col("file_language")).alias("label")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("files"))


def visible_directories(spark, d):
    return overview.visible_directories(_inventory(spark, d))


def fallback_histogram(spark, d):
    return overview.fallback_histogram(_inventory(spark, d))


def personal_order(spark, d):
    """The first sixty files of each author as a personal document lists them."""
    return overview.personal_order(_changed(spark, d).where("author is not null")).select("repo_id", "author", "place", "file_path", "change_count", "risk")


def responsibilities(spark, d):
    """What the changed files are responsible for, by number of files."""
    return _changed(spark, d).select("repo_id", "file_path").distinct().groupBy("repo_id", paths.responsibility(F.col("file_path")).alias("duty")).agg(F.count(F.lit(1)).alias("files"))


def config_files(spark, d):
    """Configuration files of each repository, those that modules list first."""
    return overview.config_files(table(spark, d, "modules"), _changed(spark, d))


def commit_windows(spark, d):
    """Dates of the first and the last commit of each author as a text."""
    commits = authors.details(table(spark, d, "commits"), _changed(spark, d).where("author is not null"))
    return commits.select("repo_id", "author", overview.range_text(F.col("first_date"), F.col("last_date")).alias("dates"))


def _pad(c):
    return F.lpad(c.cast("string"), 12, "0")


def _words(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _text(c):
    return F.coalesce(c.cast("string"), F.lit("-"))


def _first(df, keys, order, most):
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def _of_modules(modules, keys, number, most=30):
    """The routes, commands, tables and configuration files that modules list, each a part of one section."""
    out = None
    for part, (column, title) in enumerate((("routes", "Route"), ("commands", "Command"), ("table_names", "Table"), ("configs", "Configuration"))):
        held = modules.withColumn("configs", F.when(F.col("module_type") == "config", F.col("files"))).where(F.col(column).isNotNull()).select(*keys, F.explode(column).alias("item")).where("item is not null").distinct()
        lines = documents.section(_first(held, keys, ["item"], most), keys, number, [F.lit(str(part)), _pad(F.col("place"))], _words(f"- {title}: `", F.col("item"), "`"))
        out = lines if out is None else out.unionByName(lines)
    return out


def project_report_lines(spark, d):
    """The nine sections of each project's document."""
    keys = ["repo_id"]
    files, modules, changed = _inventory(spark, d), table(spark, d, "modules"), _changed(spark, d)
    source = table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content")
    people = table(spark, d, "authors").groupBy("repo_id").agg(F.count(F.lit(1)).alias("people"))
    commits = history.delivered_once(table(spark, d, "commits")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits"))
    facts = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files")).join(commits, keys, "left").join(people, keys, "left")
    languages = _first(inventory.language_histogram(files), keys, [F.desc("file_count"), "language"], 6)
    scores = frameworks.framework_scores(source)
    start = overview.start_command(projects.start_commands(source), inventory.language_histogram(files))
    analysed = relations.analysis_totals(table(spark, d, "ast_files"))
    flags = inventory.path_flags(files.select("repo_id", "file_path"))
    profile = flags.groupBy("repo_id").agg(*(F.sum(c).alias(c) for c in flags.columns[2:]))
    profile = profile.select("repo_id", F.explode(F.array(*(F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in flags.columns[2:]))).alias("x")).select("repo_id", "x.*").where("n > 0")
    listed = _first(modules.where("name is not null"), keys, ["ordinal"], 30)
    risky = changed.where("risk <> 'low'").groupBy("repo_id", "risk").agg(F.countDistinct("file_path").alias("files"))
    focus = _first(changed.groupBy("repo_id", "file_path").agg(F.coalesce(F.sum("change_count"), F.lit(0)).alias("changes")).where(paths.is_critical(F.col("file_path"))), keys, [F.desc("changes"), "file_path"], 8)
    part = lambda name, df, number, order, text: (name, documents.section(df, keys, number, order, text))
    stack = documents.section(languages, keys, 2, [F.lit("0"), _pad(F.col("place"))], _words("- Language: ", F.col("language"), " (", F.col("file_count").cast("string"), " files)"))
    stack = stack.unionByName(documents.section(scores, keys, 2, [F.lit("1"), _pad(F.col("place"))], _words("- Framework: ", F.col("framework"), " (", F.col("confidence").cast("string"), " %)")))
    stack = stack.unionByName(documents.section(start, keys, 2, [F.lit("2"), F.lit("")], _words("- Start: `", F.col("command"), "`")))
    return documents.titled([
        part("Project", facts, 1, [F.lit("")], _words("- ", overview.project_name(F.col("repo_id")), ": ", _text(F.col("files")), " files, ", _text(F.col("commits")), " commits, ", _text(F.col("people")), " spellings of people")),
        ("Stack", stack),
        part("Structure", analysed, 3, [F.lit("")], _words("- ", _text(F.col("files")), " files read, ", _text(F.col("symbols")), " symbols, ", _text(F.col("languages")), " languages")),
        part("Profile", profile, 4, [F.col("flag")], _words("- ", F.col("flag"), ": ", F.col("n").cast("string"))),
        part("Directories", overview.visible_directories(files, 30), 5, [_pad(F.col("place"))], _words("- `", F.col("directory"), "/`: ", F.col("file_count").cast("string"), " files")),
        part("Modules", listed, 6, [_pad(F.col("place"))], _words("- ", F.col("name"), " (", _text(F.col("module_type")), "): ", F.coalesce(F.size("files"), F.lit(0)).cast("string"), " files")),
        ("Routes, commands, tables and configuration", _of_modules(modules, keys, 7)),
        part("Focus", focus, 8, [_pad(F.col("place"))], _words("- `", F.col("file_path"), "`: ", F.col("changes").cast("string"), " changes, ", paths.responsibility(F.col("file_path")))),
        part("Risks", risky, 9, [F.col("risk")], _words("- ", F.col("files").cast("string"), " files of ", F.col("risk"), " risk")),
    ], keys)


def project_reports(spark, d):
    return documents.markdown(project_report_lines(spark, d), ["repo_id"])


def full_personal_lines(spark, d):
    """The nine sections of each author's document."""
    keys = ["repo_id", "author"]
    changed = _changed(spark, d).where("author is not null")
    named = authors.details(table(spark, d, "commits"), changed)
    present = overview.personal_order(changed.where("coalesce(file_exists, true)"), 35).select("repo_id", "author", "file_path", F.col("place").alias("file_place"))
    facts = methods.method_facts(methods.methods(table(spark, d, "source_files"), 20)).select("repo_id", "file_path", "ordinal", "name", "params", "intent", "notes")
    logic = present.join(facts, ["repo_id", "file_path"])
    areas = changed.groupBy(*keys, paths.business_area(F.col("file_path")).alias("area")).agg(F.countDistinct("file_path").alias("files"), F.coalesce(F.sum("change_count"), F.lit(0)).alias("changes"))
    commits = history.delivered_once(table(spark, d, "commits")).withColumn("author", authors.author_key(F.col("author_email"))).where("author is not null")
    recent = _first(commits, keys, [F.desc("commit_seq"), "hash"], 12)
    risky = authors.ranked_files(changed, 12).where("risk <> 'low'")
    own = scope.personal_modules(table(spark, d, "modules"), changed).select(*keys, "ordinal").distinct().join(table(spark, d, "modules"), ["repo_id", "ordinal"])
    hints = projects.author_hints(changed).select(*keys, F.explode(F.split("hints", ",")).alias("hint")).where("hint <> ''")
    gaps = named.where("commit_count = 0").select(*keys, F.lit("- No commits in the range: ask for the reasons behind the changes").alias("line")).unionByName(named.where("commit_count > 0").select(*keys, F.lit("- Add test data and a contact for each file at risk").alias("line")))
    part = lambda name, df, number, order, text: (name, documents.section(df, keys, number, order, text))
    history_lines = documents.section(recent, keys, 4, [F.lit("0"), _pad(F.col("place"))], _words("- `", F.col("short_hash"), "` ", _text(F.col("commit_date")), ": ", F.coalesce(snippet(F.col("message")), F.lit(""))))
    risk_lines = documents.section(risky, keys, 4, [F.lit("1"), _pad(F.col("place"))], _words("- `", F.col("file_path"), "`: ", F.col("risk"), ", ", overview.state_text(F.col("file_exists"), F.col("status"))))
    return documents.titled([
        part("Scope", named, 1, [F.lit("")], _words("- ", F.col("author"), " in ", overview.project_name(F.col("repo_id")))),
        part("Contribution", named, 2, [F.lit("")], _words("- ", F.col("commit_count").cast("string"), " commits, ", F.col("file_count").cast("string"), " files, ", F.col("change_count").cast("string"), " changes, +", F.col("additions").cast("string"), "/-", F.col("deletions").cast("string"), ", ", overview.range_text(F.col("first_date"), F.col("last_date")))),
        part("Areas", _first(areas, keys, [F.desc("changes"), "area"], 12), 3, [_pad(F.col("place"))], _words("- ", F.col("area"), ": ", F.col("files").cast("string"), " files, ", F.col("changes").cast("string"), " changes")),
        ("Commits and files at risk", history_lines.unionByName(risk_lines)),
        part("Logic", logic, 5, [_pad(F.col("file_place")), _pad(F.col("ordinal"))], _words("- `", F.col("file_path"), "` `", F.col("name"), "(", F.col("params"), ")`: ", F.col("intent"), "; ", F.array_join("notes", ", "))),
        ("Routes, commands, tables and configuration", _of_modules(own, keys, 6)),
        part("Files by changes", overview.personal_order(changed, 60), 7, [_pad(F.col("place"))], _words("- `", F.col("file_path"), "`: ", _text(F.col("change_count")), " changes, ", overview.state_text(F.col("file_exists"), F.col("status")), ", ", paths.responsibility(F.col("file_path")))),
        part("Focus", hints, 8, [F.col("hint")], _words("- ", F.col("hint"))),
        ("Next steps", documents.section(gaps, keys, 9, [F.col("line")], F.col("line"))),
    ], keys)


def full_personal_sizes(spark, d):
    return full_personal_lines(spark, d).groupBy("repo_id", "author", "section").agg(F.count(F.lit(1)).alias("lines"))


def project_prompts(spark, d):
    """What a summary of each project is asked from: names, languages, modules, files and commits in order, as one text."""
    lines = project_report_lines(spark, d).where("section in (1, 2, 3, 6, 7)")
    people = _first(table(spark, d, "authors").where("name is not null"), ["repo_id"], [F.desc("commit_count"), "name", "author_id"], 5)
    recent = history.recent_commits(table(spark, d, "commits"), 10).select("repo_id", "place", "hash", "commit_date")
    more = documents.section(people, ["repo_id"], 10, [_pad(F.col("place"))], _words("- ", F.col("name"), ": ", F.col("commit_count").cast("string"), " commits"))
    more = more.unionByName(documents.section(recent, ["repo_id"], 11, [_pad(F.col("place"))], _words("- ", F.substring("hash", 1, 8), " ", _text(F.col("commit_date")))))
    return documents.markdown(lines.unionByName(more), ["repo_id"]).withColumnRenamed("markdown", "prompt")


_LABEL = "CASE " + " ".join(f"WHEN contains(lower(file_language), '{part}') THEN '{label}'" for part, label in overview.LABELS) + " ELSE coalesce(nullif(upper(file_language[1:2]), ''), '?') END"
_ORDER = "coalesce(file_exists, true) DESC, change_count DESC NULLS LAST, CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, file_path, status NULLS FIRST, additions NULLS FIRST, deletions NULLS FIRST, last_commit_date NULLS FIRST, module_name NULLS FIRST, file_language NULLS FIRST, file_exists NULLS FIRST"

_KIND = "CASE " + " ".join(f"WHEN {dict(contains='contains', startswith='prefix', endswith='suffix')[t]}(file_path, {sql.quoted(n)}) THEN '{c}'" for c, t, n in paths.CATEGORIES) + " ELSE 'other' END"
_DUTY = "CASE kind " + " ".join(f"WHEN '{code}' THEN " + (f"{sql.quoted(duty.partition('{}')[0])} || area || {sql.quoted(duty.partition('{}')[2])}" if "{}" in duty else sql.quoted(duty)) for code, duty in paths.DUTIES.items()) + " ELSE 'belongs to ' || area END"

QUERIES = {
    "language_labels": (language_labels, f"SELECT label, count(*) AS files FROM (SELECT DISTINCT file_id, {_LABEL} AS label FROM source_files) GROUP BY ALL"),
    "visible_directories": (visible_directories, f"WITH {sql.INVENTORY}, counts AS (SELECT repo_id, string_split(file_path, '/')[1] AS directory, count(*) AS file_count FROM inventory WHERE contains(file_path, '/') AND NOT starts_with(file_path, '.') GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, directory) AS place FROM counts) SELECT * FROM ranked WHERE place <= 50"),
    "fallback_histogram": (fallback_histogram, f"WITH {sql.INVENTORY}, counts AS (SELECT repo_id, language, count(*) AS file_count FROM inventory WHERE language IS NOT NULL AND language <> 'Unknown' GROUP BY ALL) SELECT *, round(file_count * 100 / sum(file_count) OVER (PARTITION BY repo_id))::BIGINT AS percent FROM counts"),
    "personal_order": (personal_order, f"WITH {sql.RISK}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, author ORDER BY {_ORDER}) AS place FROM risked WHERE author IS NOT NULL) SELECT repo_id, author, place, file_path, change_count, risk FROM ranked WHERE place <= 60"),
    "responsibilities": (responsibilities, f"WITH {sql.FILES}, named AS (SELECT DISTINCT repo_id, file_path FROM files_once), told AS (SELECT repo_id, {_KIND} AS kind, {sql.business_area('file_path')} AS area FROM named) SELECT repo_id, {_DUTY} AS duty, count(*) AS files FROM told GROUP BY ALL"),
    "config_files": (config_files, f"WITH {sql.FILES}, held AS (SELECT DISTINCT repo_id, unnest(files) AS file_path, 0 AS part FROM modules WHERE module_type = 'config' UNION SELECT DISTINCT repo_id, file_path, 1 FROM files_once WHERE regexp_matches(lower(file_path), '(^|/)config/|\\.(ya?ml|toml|ini|conf|cfg|properties)$')), best AS (SELECT repo_id, min(part) AS best FROM held GROUP BY ALL) SELECT repo_id, file_path, part::BIGINT AS part FROM held JOIN best USING (repo_id) WHERE part = best"),
    "commit_windows": (commit_windows, f"SELECT repo_id, author, CASE WHEN first_date IS NULL AND last_date IS NULL THEN '-' WHEN coalesce(first_date = last_date, true) THEN coalesce(first_date, last_date) ELSE first_date || ' to ' || last_date END AS dates FROM ({histories.QUERIES['author_details'][1]}) WHERE author IS NOT NULL"),
    "project_reports": (project_reports, None),
    "full_personal_sizes": (full_personal_sizes, None),
    "project_prompts": (project_prompts, None),
}
