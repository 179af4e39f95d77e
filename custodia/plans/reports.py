"""Queries on progress feeds and hand-over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from custodia.functions.text import snippet
from custodia.operators import authors, history
from custodia.plans import sql
from custodia.render import documents
from custodia.sources.tables import table
from custodia.streaming import progress


def progress_monotonic(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return progress.reached(events, "user_id", ["ts", "event_id"], "value", "event_type").select("event_id", "user_id", "reached")


def event_windows(spark, d):
    return progress.windowed_counts(table(spark, d, "events"), "event_type", "ts").select("event_type", F.unix_timestamp("window_start").alias("window_start"), "events")


def personal_report_lines(spark, d):
    """The lines of each author's document: twelve risk files, eight modules and twelve recent commits."""
    files = authors.with_risk(authors.files_once(table(spark, d, "changed_files"))).where("author is not null")
    keys = ["repo_id", "author"]
    risky = authors.ranked_files(files, 12).where("risk <> 'low'")
    most = Window.partitionBy(*keys).orderBy(F.desc("change_count"), F.desc("file_count"), "name")
    modules = authors.contributions(files, "module_name").withColumn("place", F.row_number().over(most)).where("place <= 8")
    commits = history.delivered_once(table(spark, d, "commits")).withColumn("author", authors.author_key(F.col("author_email"))).where("author is not null")
    newest = Window.partitionBy(*keys).orderBy(F.desc("commit_seq"), "hash")
    commits = commits.withColumn("place", F.row_number().over(newest)).where("place <= 12")
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    parts = [
        ("Files at risk", documents.section(risky, keys, 1, [pad(F.col("place"))], F.concat(F.lit("- `"), F.col("file_path"), F.lit("` ("), F.col("risk"), F.lit(")")))),
        ("Modules", documents.section(modules, keys, 2, [pad(F.col("place"))], F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("file_count").cast("string"), F.lit(" files, "), F.col("change_count").cast("string"), F.lit(" changes")))),
        ("Commits", documents.section(commits, keys, 3, [pad(F.col("place"))], F.concat(F.lit("- "), F.col("short_hash"), F.lit(" "), F.coalesce(snippet(F.col("message")), F.lit(""))))),
    ]
    return documents.titled(parts, keys)


def report_sizes(spark, d):
    lines = personal_report_lines(spark, d)
    return lines.groupBy("repo_id", "author", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


def personal_reports(spark, d):
    return documents.markdown(personal_report_lines(spark, d), ["repo_id", "author"])


def personal_pages(spark, d):
    return documents.as_html(personal_reports(spark, d), ["repo_id", "author"])


_RANK = "row_number() OVER (PARTITION BY repo_id, author ORDER BY coalesce(file_exists, true) DESC, CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, change_count DESC NULLS LAST, file_path, status NULLS FIRST, additions NULLS FIRST, deletions NULLS FIRST, last_commit_date NULLS FIRST, module_name NULLS FIRST, file_language NULLS FIRST, file_exists NULLS FIRST)"
_LINE = "trim(regexp_replace(replace(message, '`', ''''), '[ \\t\\r\\n]+', ' ', 'g'))"
_SIZES = f"""WITH {sql.RISK}, {sql.COMMITS}, ranked AS (SELECT *, {_RANK} AS place FROM risked WHERE author IS NOT NULL),
modules AS (SELECT repo_id, author, coalesce(nullif(trim(module_name), ''), 'Unknown') AS name, count(*) AS n, coalesce(sum(change_count), 0)::BIGINT AS c FROM files_once WHERE author IS NOT NULL GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY repo_id, author ORDER BY c DESC, n DESC, name) AS place FROM modules),
newest AS (SELECT *, row_number() OVER (PARTITION BY repo_id, {sql.key('author_email')} ORDER BY commit_seq DESC, hash) AS place FROM commits_once WHERE author_email IS NOT NULL),
lines AS (SELECT repo_id, author, 1 AS section, '- `' || file_path || '` (' || risk || ')' AS line FROM ranked WHERE place <= 12 AND risk <> 'low'
 UNION ALL SELECT repo_id, author, 2, '- ' || name || ': ' || n || ' files, ' || c || ' changes' FROM best WHERE place <= 8
 UNION ALL SELECT repo_id, {sql.key('author_email')}, 3, '- ' || short_hash || ' ' || coalesce(CASE WHEN length({_LINE}) > 72 THEN {_LINE}[1:72] || '...' ELSE {_LINE} END, '') FROM newest WHERE place <= 12),
headed AS (SELECT * FROM lines UNION ALL SELECT DISTINCT repo_id, author, section, '## ' || section || '. ' || CASE section WHEN 1 THEN 'Files at risk' WHEN 2 THEN 'Modules' ELSE 'Commits' END FROM lines)
SELECT repo_id, author, section::BIGINT AS section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM headed GROUP BY ALL"""

QUERIES = {
    "progress_monotonic": (progress_monotonic, "WITH marked AS (SELECT *, max(value) OVER w AS reached, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT event_id, user_id, reached FROM marked WHERE before IS NULL OR before <> event_type"),
    "event_windows": (event_windows, "SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*) AS events FROM events GROUP BY ALL"),
    "report_sizes": (report_sizes, _SIZES),
    "personal_reports": (personal_reports, None),
    "personal_pages": (personal_pages, None),
}
