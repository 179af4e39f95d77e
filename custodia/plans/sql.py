"""Pieces of SQL that the comparison queries share."""

from __future__ import annotations

from custodia.rules import files, languages


def key(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), '^<|>$', '', 'g'))"


def path(x: str) -> str:
    return f"trim(regexp_replace(replace(trim({x}), '\\', '/'), '^/+', ''))"


def name(x: str) -> str:
    return f"regexp_extract({x}, '([^/]*)$', 1)"


def extension(x: str) -> str:
    return f"lower(regexp_extract({name(x)}, '.(\\.[^.]*)$', 1))"


def directory(x: str) -> str:
    return f"regexp_replace({x}, '/?[^/]*$', '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"


def language(x: str) -> str:
    low, end = f"lower({name(x)})", extension(x)
    return f"CASE WHEN {low} LIKE '%.blade.php' THEN 'Blade' WHEN {end} = '.m' AND regexp_matches(lower({x}), '(^|/)(ios|macos|objc)/') THEN 'Objective-C' ELSE coalesce({case(low, languages.BY_NAME)}, {case(end, languages.BY_EXTENSION)}) END"


def history_language(x: str) -> str:
    return f"coalesce({case(extension(x), languages.HISTORY)}, 'Unknown')"


def stem(x: str) -> str:
    return f"regexp_replace({x}, '\\.[^.]*$', '')"


def module_name(x: str) -> str:
    parts = f"string_split({x}, '/')"
    tests = ""
    for markers in files.MODULE_MARKERS:
        at = "least(" + ", ".join(f"nullif(coalesce(list_position({parts}, {quoted(m)}), 0), 0)" for m in markers) + ")"
        tests += f" WHEN {at} IS NOT NULL THEN coalesce(nullif({stem(f'{parts}[{at} + 1]')}, ''), {parts}[{at}])"
    plain = f"CASE WHEN len({parts}) > 1 THEN {parts}[1] || '/' || {stem(f'{parts}[2]')} ELSE {stem(f'{parts}[1]')} END"
    return f"coalesce(CASE {tests} END, nullif({plain}, ''), 'Root')"


def business_area(x: str) -> str:
    parts = f"string_split({x}, '/')"
    tests = ""
    for marker in ("Controllers", "Models", "Services", "Service", "Commands"):
        at = f"nullif(coalesce(list_position({parts}, '{marker}'), 0), 0)"
        tests += f" WHEN {at} IS NOT NULL THEN CASE WHEN {parts}[{at} + 1] IS NULL OR {parts}[{at} + 1] LIKE '%.php' THEN '{marker}' ELSE '{marker}/' || {parts}[{at} + 1] END"
    return f"coalesce(CASE {tests} END, CASE WHEN {parts}[1] IN ('routes', 'config', 'database') THEN {parts}[1] END, nullif(concat_ws('/', {parts}[1], {parts}[2]), ''), 'Other')"


COMMITS = "commits_once AS (SELECT DISTINCT repo_id, commit_seq, hash, short_hash, author_name, author_email, commit_date, message FROM commits)"
CHANGES = f"changes_once AS (SELECT DISTINCT repo_id, hash, change_idx, status, {path('file_path')} AS file_path, {path('previous_path')} AS previous_path FROM file_changes)"
AUTHORED = (
    f"{COMMITS}, {CHANGES}, authored AS (SELECT ch.*, c.commit_seq, c.short_hash, c.commit_date, coalesce(nullif({key('author_email')}, ''), nullif({key('author_name')}, ''), 'unknown') AS author "
    "FROM changes_once ch JOIN commits_once c USING (repo_id, hash))"
)
FILES = (
    f"files_once AS (SELECT DISTINCT repo_id, {key('author_email')} AS author, {path('file_path')} AS file_path, change_count, additions, deletions, last_commit_date, status, file_exists, module_name, file_language "
    "FROM changed_files WHERE file_path IS NOT NULL)"
)
_LINES = "(coalesce(additions, 0) + coalesce(deletions, 0))"
_POINTS = f"(coalesce(change_count >= 8, false)::INT + coalesce({_LINES} >= 500, false)::INT + coalesce(status = 'deleted', false)::INT + coalesce(status = 'renamed', false)::INT + regexp_matches(lower(file_path), '(auth|payment|order|billing|permission|security|migration|config|routes?/)')::INT)"
RISK = f"{FILES}, pointed AS (SELECT *, {_POINTS}::BIGINT AS risk_points, {_LINES} AS lines FROM files_once), risked AS (SELECT *, CASE WHEN risk_points >= 3 OR coalesce(change_count >= 12, false) OR lines >= 1000 THEN 'high' WHEN risk_points >= 1 OR coalesce(change_count >= 5, false) OR lines >= 300 THEN 'medium' ELSE 'low' END AS risk FROM pointed)"
SOURCES = "sources AS (SELECT DISTINCT file_id, repo_id, file_path, file_language, content FROM source_files)"
INVENTORY = f"inventory AS (SELECT DISTINCT file_id, repo_id, file_path, size_bytes, {name('file_path')} AS name, {extension('file_path')} AS extension, {language('file_path')} AS language FROM source_files)"
