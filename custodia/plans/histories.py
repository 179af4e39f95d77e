"""Queries on commits, changes and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.functions.history import author_key, risk_weight
from custodia.functions.paths import normal_path
from custodia.functions.text import repository_name
from custodia.operators import authors, history
from custodia.plans import sql
from custodia.sources.tables import table


def _authored(spark: SparkSession, d: str) -> DataFrame:
    return history.authored_changes(table(spark, d, "commits"), table(spark, d, "file_changes"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return authors.files_once(table(spark, d, "changed_files"))


def author_commit_counts(spark, d):
    return authors.commit_counts(table(spark, d, "commits"))


def author_profile(spark, d):
    """The twenty riskiest files of each author."""
    ranked = authors.ranked_files(authors.with_risk(_files(spark, d)), 20)
    return ranked.select("repo_id", "author", "place", "file_path", "change_count", "status", "risk", "risk_points")


def changed_file_profile(spark, d):
    return history.file_profiles(_authored(spark, d))


def status_merge_fold(spark, d):
    return history.file_profiles(_authored(spark, d)).groupBy("repo_id", "author", "status").agg(F.count(F.lit(1)).alias("file_count"))


def rename_fold(spark, d):
    folded = history.rename_fold(_authored(spark, d))
    return folded.withColumn("hashes", F.array_join("hashes", ","))


def first_last_commit(spark, d):
    order = F.struct("commit_seq", "hash")
    return _authored(spark, d).groupBy("repo_id", "author").agg(F.min_by("commit_date", order).alias("first_date"), F.max_by("commit_date", order).alias("last_date"), F.countDistinct("hash").alias("commit_count"), F.countDistinct("file_path").alias("file_count"))


def commit_summary(spark, d):
    return history.commit_summaries(table(spark, d, "commits"), table(spark, d, "file_changes"))


def recent_commits(spark, d):
    return history.recent_commits(table(spark, d, "commits"))


def author_lookup(spark, d):
    """Commits of one author given by name and address; the address decides."""
    return authors.commits_of(table(spark, d, "commits"), "Anybody <Release.Train@norvane.example>").select("repo_id", "hash", "commit_seq", "author_name")


def commits_in_range(spark, d):
    commits = history.delivered_once(table(spark, d, "commits"))
    return commits.where("commit_date >= '2022-01-01' and commit_date <= '2023-06-30'").groupBy("repo_id", F.substring("commit_date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("commit_count"))


def numstat_attach(spark, d):
    """Line counts of a log in which renames are printed in short form, attached to the changes by path, previous path or ending."""
    changes = history.changes_once(table(spark, d, "file_changes"))
    stem = F.regexp_extract("file_path", "([^/]*)$", 1)
    printed = F.when(F.col("previous_path").isNotNull(), F.concat(F.lit("{"), F.col("previous_path"), F.lit(" => "), F.col("file_path"), F.lit("}"))).when(F.col("change_idx") % 5 == 0, stem).otherwise(F.col("file_path"))
    lines = changes.select("repo_id", "hash", F.col("change_idx").alias("stat_idx"), F.concat_ws("\t", F.length("file_path").cast("string"), F.when(F.col("change_idx") % 7 == 0, "-").otherwise(F.col("change_idx").cast("string")), printed).alias("value"))
    stats = history.line_stats(lines).withColumnRenamed("file_path", "stat_path").drop("value")
    return history.with_line_stats(changes, stats)


def contribution_by_module(spark, d):
    return authors.contributions(_files(spark, d), "module_name")


def contribution_by_language(spark, d):
    return authors.contributions(_files(spark, d), "file_language")


def business_area_topk(spark, d):
    return authors.area_files(_files(spark, d))


def risk_levels(spark, d):
    return authors.with_risk(_files(spark, d)).groupBy("repo_id", "risk", "risk_points").agg(F.count(F.lit(1)).alias("file_count"), F.sum(risk_weight(F.col("risk"))).cast("long").alias("weight"))


def author_details(spark, d):
    return authors.details(table(spark, d, "commits"), _files(spark, d))


def author_scopes(spark, d):
    """The summary of authors beside the commits that a history of one branch holds of each."""
    summary = table(spark, d, "authors").groupBy("repo_id", author_key(F.col("email")).alias("author")).agg(F.sum("commit_count").cast("long").alias("all_refs"), F.count(F.lit(1)).alias("spellings"))
    return summary.join(authors.commit_counts(table(spark, d, "commits")).select("repo_id", "author", F.col("commit_count").alias("on_branch")), ["repo_id", "author"], "left")


def change_notation(spark, d):
    """Paths that are written in another notation."""
    raw = table(spark, d, "file_changes").select("file_path").distinct()
    return raw.select("file_path", normal_path(F.col("file_path")).alias("normal")).where("file_path <> normal")


def repositories(spark, d):
    """Short names of repositories with their activity."""
    commits = history.delivered_once(table(spark, d, "commits"))
    return commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commit_count"), F.countDistinct(author_key(F.col("author_email"))).alias("authors")).withColumn("name", repository_name(F.concat(F.lit("https://forge.example/"), F.col("repo_id"), F.lit(".git?x=1"))))


_FOLD = "list_reduce(list_prepend('other', list(status ORDER BY commit_seq, hash, change_idx)), lambda a, b: CASE WHEN a = b THEN a WHEN a = 'other' THEN b WHEN b = 'deleted' THEN 'deleted' WHEN a = 'renamed' OR b = 'renamed' THEN 'renamed' WHEN b = 'added' AND a = 'modified' THEN 'added' ELSE a END)"
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in history.STATUSES)
_ORDER = "(commit_seq, hash, change_idx)"
_PROFILE = f"""WITH {sql.AUTHORED} SELECT repo_id, author, file_path, count(*) AS change_count, count(DISTINCT hash) AS commit_count, arg_min(coalesce(commit_date, '\x01'), {_ORDER}) AS first_date,
 arg_max(coalesce(commit_date, '\x01'), {_ORDER}) AS last_date, arg_max(short_hash, {_ORDER}) AS last_hash, {_COUNTS}, {_FOLD} AS status FROM authored GROUP BY ALL"""
_PROFILE = f"SELECT * REPLACE (nullif(first_date, '\x01') AS first_date, nullif(last_date, '\x01') AS last_date) FROM ({_PROFILE})"
_RANK = "row_number() OVER (PARTITION BY repo_id, author ORDER BY coalesce(file_exists, true) DESC, CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, change_count DESC NULLS LAST, file_path, status NULLS FIRST, additions NULLS FIRST, deletions NULLS FIRST, last_commit_date NULLS FIRST, module_name NULLS FIRST, file_language NULLS FIRST, file_exists NULLS FIRST)"


def _contribution(column: str) -> str:
    return f"WITH {sql.FILES} SELECT repo_id, author, coalesce(nullif(trim({column}), ''), 'Unknown') AS name, count(*) AS file_count, coalesce(sum(change_count), 0)::BIGINT AS change_count, coalesce(sum(additions), 0)::BIGINT AS additions, coalesce(sum(deletions), 0)::BIGINT AS deletions FROM files_once GROUP BY ALL"


def risk_reason_counts(spark, d):
    """How often each reason for a risk holds in each repository."""
    files = authors.with_reasons(authors.files_once(table(spark, d, "changed_files")))
    return files.select("repo_id", F.explode("reasons").alias("reason")).groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("files"))


_REASONS = " UNION ALL ".join(
    f"SELECT repo_id, '{code}' AS reason FROM files_once WHERE {test}"
    for code, test in (("many_changes", "change_count >= 8"), ("many_lines", "coalesce(additions, 0) + coalesce(deletions, 0) >= 500"), ("deleted", "status = 'deleted'"), ("renamed", "status = 'renamed'"), ("critical_path", "regexp_matches(lower(file_path), '(auth|payment|order|billing|permission|security|migration|config|routes?/)')"))
)

QUERIES = {
    "risk_reason_counts": (risk_reason_counts, f"WITH {sql.FILES} SELECT repo_id, reason, count(*) AS files FROM ({_REASONS}) GROUP BY ALL"),
    "author_commit_counts": (author_commit_counts, f"WITH {sql.COMMITS} SELECT repo_id, {sql.key('author_email')} AS author, count(*) AS commit_count, min(commit_seq) AS first_seq, max(commit_seq) AS last_seq FROM commits_once GROUP BY ALL"),
    "author_profile": (author_profile, f"WITH {sql.RISK}, ranked AS (SELECT *, {_RANK} AS place FROM risked) SELECT repo_id, author, place, file_path, change_count, status, risk, risk_points FROM ranked WHERE place <= 20"),
    "changed_file_profile": (changed_file_profile, _PROFILE),
    "status_merge_fold": (status_merge_fold, f"SELECT repo_id, author, status, count(*) AS file_count FROM ({_PROFILE}) GROUP BY ALL"),
    "rename_fold": (rename_fold, None),
    "first_last_commit": (first_last_commit, f"SELECT * REPLACE (nullif(first_date, '\x01') AS first_date, nullif(last_date, '\x01') AS last_date) FROM (WITH {sql.AUTHORED} SELECT repo_id, author, arg_min(coalesce(commit_date, '\x01'), (commit_seq, hash)) AS first_date, arg_max(coalesce(commit_date, '\x01'), (commit_seq, hash)) AS last_date, count(DISTINCT hash) AS commit_count, count(DISTINCT file_path) AS file_count FROM authored GROUP BY ALL)"),
    "commit_summary": (commit_summary, f"WITH {sql.COMMITS}, {sql.CHANGES}, firsts AS (SELECT repo_id, hash, file_path, min(change_idx) AS place FROM changes_once GROUP BY ALL), listed AS (SELECT repo_id, hash, count(*) AS n, string_agg(file_path, '|' ORDER BY place, file_path) AS files FROM firsts GROUP BY ALL) SELECT repo_id, hash, commit_seq, author_name, commit_date, coalesce(n, 0)::BIGINT AS file_count, coalesce(files, '') AS files FROM commits_once LEFT JOIN listed USING (repo_id, hash)"),
    "recent_commits": (recent_commits, f"WITH {sql.COMMITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commit_seq DESC, hash) AS place FROM commits_once) SELECT repo_id, place, hash, commit_seq, commit_date FROM ranked WHERE place <= 20"),
    "author_lookup": (author_lookup, f"WITH {sql.COMMITS} SELECT repo_id, hash, commit_seq, author_name FROM commits_once WHERE {sql.key('author_email')} = 'release.train@norvane.example'"),
    "commits_in_range": (commits_in_range, f"WITH {sql.COMMITS} SELECT repo_id, commit_date[1:7] AS month, count(*) AS commit_count FROM commits_once WHERE commit_date >= '2022-01-01' AND commit_date <= '2023-06-30' GROUP BY ALL"),
    "numstat_attach": (numstat_attach, f"""WITH {sql.CHANGES}, stats AS (SELECT repo_id, hash, change_idx AS stat_idx, length(file_path) AS additions, CASE WHEN change_idx % 7 = 0 THEN 0 ELSE change_idx END AS deletions,
 CASE WHEN previous_path IS NOT NULL THEN file_path WHEN change_idx % 5 = 0 THEN {sql.name('file_path')} ELSE file_path END AS stat_path FROM changes_once),
exact AS (SELECT repo_id, hash, stat_path, arg_min({{'a': additions, 'd': deletions}}, stat_idx) AS s FROM stats GROUP BY ALL),
looked AS (SELECT c.*, e1.s AS s1, e2.s AS s2 FROM changes_once c LEFT JOIN exact e1 ON e1.repo_id = c.repo_id AND e1.hash = c.hash AND e1.stat_path = c.file_path LEFT JOIN exact e2 ON e2.repo_id = c.repo_id AND e2.hash = c.hash AND e2.stat_path = c.previous_path),
ended AS (SELECT l.repo_id, l.hash, l.change_idx, arg_min({{'a': additions, 'd': deletions}}, stat_idx) AS s3 FROM looked l JOIN stats t USING (repo_id, hash) WHERE s1 IS NULL AND s2 IS NULL AND (suffix(file_path, '/' || stat_path) OR suffix(stat_path, '/' || file_path)) GROUP BY ALL)
SELECT repo_id, hash, change_idx::BIGINT AS change_idx, status, file_path, previous_path, coalesce(coalesce(s1, s2, s3).a, 0)::BIGINT AS additions, coalesce(coalesce(s1, s2, s3).d, 0)::BIGINT AS deletions FROM looked LEFT JOIN ended USING (repo_id, hash, change_idx)"""),
    "contribution_by_module": (contribution_by_module, _contribution("module_name")),
    "contribution_by_language": (contribution_by_language, _contribution("file_language")),
    "business_area_topk": (business_area_topk, f"""WITH {sql.FILES}, summed AS (SELECT repo_id, {sql.business_area('file_path')} AS area, file_path, coalesce(sum(change_count), 0)::BIGINT AS changes FROM files_once GROUP BY ALL),
totals AS (SELECT repo_id, area, sum(changes)::BIGINT AS area_changes, count(*) AS file_count FROM summed GROUP BY ALL), areas AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY area_changes DESC, area) AS area_place FROM totals),
best AS (SELECT *, row_number() OVER (PARTITION BY repo_id, area ORDER BY changes DESC, file_path) AS file_place FROM summed)
SELECT repo_id, area_place, area, area_changes, file_count, file_place, file_path, changes FROM best JOIN areas USING (repo_id, area) WHERE area_place <= 12 AND file_place <= 5"""),
    "risk_levels": (risk_levels, f"WITH {sql.RISK} SELECT repo_id, risk, risk_points, count(*) AS file_count, sum(CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::BIGINT AS weight FROM risked GROUP BY ALL"),
    "author_details": (author_details, f"""WITH {sql.FILES}, {sql.COMMITS}, own AS (SELECT repo_id, author, count(DISTINCT file_path) AS file_count, coalesce(sum(change_count), 0)::BIGINT AS change_count, coalesce(sum(additions), 0)::BIGINT AS additions, coalesce(sum(deletions), 0)::BIGINT AS deletions FROM files_once GROUP BY ALL),
made AS (SELECT repo_id, {sql.key('author_email')} AS author, count(*) AS commit_count, arg_min(coalesce(commit_date, '\x01'), (commit_seq, hash)) AS first_date, arg_max(coalesce(commit_date, '\x01'), (commit_seq, hash)) AS last_date FROM commits_once GROUP BY ALL)
SELECT own.*, coalesce(commit_count, 0)::BIGINT AS commit_count, nullif(first_date, '\x01') AS first_date, nullif(last_date, '\x01') AS last_date FROM own LEFT JOIN made USING (repo_id, author)"""),
    "author_scopes": (author_scopes, f"""WITH {sql.COMMITS}, summary AS (SELECT repo_id, {sql.key('email')} AS author, sum(commit_count)::BIGINT AS all_refs, count(*) AS spellings FROM authors GROUP BY ALL),
made AS (SELECT repo_id, {sql.key('author_email')} AS author, count(*) AS on_branch FROM commits_once GROUP BY ALL) SELECT summary.*, on_branch FROM summary LEFT JOIN made USING (repo_id, author)"""),
    "change_notation": (change_notation, f"SELECT DISTINCT file_path, {sql.path('file_path')} AS normal FROM file_changes WHERE file_path <> {sql.path('file_path')}"),
    "repositories": (repositories, f"WITH {sql.COMMITS} SELECT repo_id, count(*) AS commit_count, count(DISTINCT {sql.key('author_email')}) AS authors, regexp_extract(repo_id, '([^/:]*)$', 1) AS name FROM commits_once GROUP BY ALL"),
}
