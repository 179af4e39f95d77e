"""Operators on commits and file changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions.history import author_key, merged_status, stat_path, status_of
from custodia.functions.paths import normal_path
from custodia.session import cut

STATUSES = ["added", "modified", "deleted", "renamed", "copied", "other"]


def commit_headers(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Commits of a log whose headers separate fields by the unit separator; a message may hold it too."""
    parts = F.split(column, "\x1f")
    field = lambda k: F.try_element_at(parts, F.lit(k))
    message = F.array_join(F.slice(parts, 6, F.greatest(F.size(parts) - 5, F.lit(0))), "\x1f")
    return lines.where(F.size(parts) >= 6).select(*keep, field(1).alias("hash"), field(2).alias("short_hash"), field(3).alias("author_name"), field(4).alias("author_email"), field(5).alias("commit_date"), message.alias("message"))


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Status, path and previous path of lines of a name-status log; lines of fewer than two fields are left out."""
    parts = F.filter(F.split(column, "\t+"), lambda x: x != "")
    code, second, third = (F.try_element_at(parts, F.lit(k)) for k in (1, 2, 3))
    moved = code.rlike("^[RC]") & third.isNotNull()
    return lines.where(F.size(parts) >= 2).select("*", status_of(code).alias("status"), normal_path(F.when(moved, third).otherwise(second)).alias("file_path"), F.when(moved, normal_path(second)).alias("previous_path"))


def line_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """Added and deleted lines and the new path of lines of a numstat log; binary files count 0."""
    parts = F.split(column, "\t")
    number = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("long"), F.lit(0))
    path = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "\t")
    return lines.where(F.size(parts) >= 3).select("*", number(1).alias("additions"), number(2).alias("deletions"), normal_path(stat_path(path)).alias("file_path"))


def delivered_once(commits: DataFrame) -> DataFrame:
    """Commits without repeated deliveries, which differ in their arrival only."""
    return commits.select("repo_id", "commit_seq", "hash", "short_hash", "author_name", "author_email", "commit_date", "message").distinct()


def changes_once(file_changes: DataFrame) -> DataFrame:
    """File changes without repeated rows, with normal paths."""
    return file_changes.select("repo_id", "hash", "change_idx", "status", normal_path(F.col("file_path")).alias("file_path"), normal_path(F.col("previous_path")).alias("previous_path")).distinct()


def authored_changes(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Each file change with its commit and the author's key, the address or else the name."""
    key = F.coalesce(F.nullif(author_key(F.col("author_email")), F.lit("")), F.nullif(author_key(F.col("author_name")), F.lit("")), F.lit("unknown"))
    return changes_once(file_changes).join(delivered_once(commits).withColumn("author", key), ["repo_id", "hash"])


def _endings(path: Column) -> Column:
    """What is left of a path without its first segment, its first two, and so on."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def with_line_stats(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """Changes with their line counts: by path, else by previous path, else by a path that ends with the other; 0 if none fits.

    Keys are ``repo_id`` and ``hash``. Of several that fit by ending, the first in the log counts. Endings are
    matched by joins on their text, so the files of a large commit never meet all at once.
    """
    commit = ["repo_id", "hash"]
    exact = stats.groupBy(*commit, "stat_path").agg(F.min_by(F.struct("additions", "deletions"), "stat_idx").alias("s"))
    first = changes.join(exact.select(*commit, F.col("stat_path").alias("file_path"), F.col("s").alias("s1")), [*commit, "file_path"], "left")
    second = first.join(exact.select(*commit, F.col("stat_path").alias("previous_path"), F.col("s").alias("s2")), [*commit, "previous_path"], "left")
    open_rows = second.where("s1 is null and s2 is null").select(*commit, "change_idx", "file_path")
    named = stats.select(*commit, "stat_idx", "stat_path", "additions", "deletions")
    longer = open_rows.withColumn("stat_path", F.explode(_endings(F.col("file_path")))).join(named, [*commit, "stat_path"])
    shorter = open_rows.join(named.withColumn("file_path", F.explode(_endings(F.col("stat_path")))), [*commit, "file_path"])
    both = longer.select(*commit, "change_idx", "stat_idx", "additions", "deletions").unionByName(shorter.select(*commit, "change_idx", "stat_idx", "additions", "deletions"))
    third = both.groupBy(*commit, "change_idx").agg(F.min_by(F.struct("additions", "deletions"), "stat_idx").alias("s3"))
    found = second.join(third, [*commit, "change_idx"], "left").withColumn("s", F.coalesce("s1", "s2", "s3"))
    zero = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0)).cast("long").alias(name)
    return found.select(*commit, "change_idx", "status", "file_path", "previous_path", zero("additions"), zero("deletions"))


BLOCK_COMMITS = 4_096


def file_profiles(changes: DataFrame, block_commits: int = BLOCK_COMMITS) -> DataFrame:
    """What each author did to each file, by the path at that time; the status depends on the order of the changes.

    The changes of ``block_commits`` neighbouring commits become one map, from each status held before to the one held after
    them. Maps are composed in order, so a file that one author changes very often is never held change by change in one row.
    """
    keys = ["repo_id", "author", "file_path"]
    order = F.struct("commit_seq", "hash", "change_idx")
    blocks = changes.withColumn("block", F.floor(F.col("commit_seq") / block_commits)).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("change_count"),
        F.countDistinct("hash").alias("commit_count"),
        F.min(F.struct(order.alias("at"), "commit_date")).alias("first"),
        F.max(F.struct(order.alias("at"), "commit_date", "short_hash")).alias("last"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.array_sort(F.collect_list(F.struct("commit_seq", "hash", "change_idx", "status"))).alias("history"),
    )
    held = F.array(*(F.lit(s) for s in STATUSES))
    after = F.array(*(F.aggregate("history", F.lit(s), lambda state, row: merged_status(state, row["status"])) for s in STATUSES))
    grouped = blocks.withColumn("after", after).groupBy(*keys).agg(
        F.sum("change_count").alias("change_count"),
        F.sum("commit_count").alias("commit_count"),
        F.min("first")["commit_date"].alias("first_date"),
        F.max("last").alias("last"),
        *(F.sum(s).alias(s) for s in STATUSES),
        F.array_sort(F.collect_list(F.struct("block", "after"))).alias("steps"),
    )
    status = F.aggregate("steps", F.lit("other"), lambda state, step: F.element_at(step["after"], F.array_position(held, state).cast("int")))
    return grouped.select(*keys, "change_count", "commit_count", "first_date", F.col("last.commit_date").alias("last_date"), F.col("last.short_hash").alias("last_hash"), *STATUSES, status.alias("status"))


def _components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that is connected with it. Each round also follows the roots of roots."""
    both = cut(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("low"), "root")
        above = labels.select(F.col("node").alias("low"), F.col("root").alias("top"))
        moved = cut(lower.join(above, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("next"), "root"))
        labels = moved.select("node", F.col("next").alias("root"))
        if moved.where("next <> root").isEmpty():
            return labels


_FOLDED = (
    "repo_id string, author string, file_path string, previous_path string, status string, change_count long, hashes array<string>, first_date string, last_date string, last_hash string, last_message string, "
    + ", ".join(f"{s} long" for s in STATUSES)
)


def _merged(held: str, following: str) -> str:
    if held == following or held == "other":
        return following
    if following == "deleted":
        return "deleted"
    if "renamed" in (held, following):
        return "renamed"
    return "added" if (following, held) == ("added", "modified") else held


def fold_changes(rows) -> list[dict]:
    """Follows files through renames over ``rows`` in order: (status, path, previous path, short hash, date, message)."""
    files: dict[str, dict] = {}
    for status, path, previous, short, date, message in rows:
        if status == "renamed" and previous and previous in files and previous != path:
            entry = files.pop(previous)
            files.pop(path, None)
            entry["previous_path"] = entry["previous_path"] or previous
            files[path] = entry
        entry = files.get(path)
        if entry is None:
            entry = files[path] = {"previous_path": previous if status == "renamed" else None, "status": "other", "change_count": 0, "hashes": [], "first_date": date, "counts": dict.fromkeys(STATUSES, 0)}
        entry["change_count"] += 1
        entry["hashes"].append(short)
        entry["last_date"], entry["last_hash"], entry["last_message"] = date, short, message
        entry["status"] = _merged(entry["status"], status)
        entry["counts"][status if status in entry["counts"] else "other"] += 1
    return [entry | {"file_path": path} for path, entry in files.items()]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    key, rows = None, []

    def done() -> list[tuple]:
        return [(*key[:2], e["file_path"], e["previous_path"], e["status"], e["change_count"], e["hashes"], e["first_date"], e["last_date"], e["last_hash"], e["last_message"], *(e["counts"][s] for s in STATUSES)) for e in fold_changes(rows)]

    names = [x.split()[0] for x in _FOLDED.split(", ")]
    schema = [pa.string()] * 5 + [pa.int64(), pa.list_(pa.string())] + [pa.string()] * 4 + [pa.int64()] * len(STATUSES)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema)], names)

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(x).to_pylist() for x in ("repo_id", "author", "root", "status", "file_path", "previous_path", "short_hash", "commit_date", "message")]
        for repo, author, root, *row in zip(*columns):
            if (repo, author, root) != key:
                if rows:
                    out.extend(done())
                key, rows = (repo, author, root), []
            rows.append(row)
        yield packed(out)
    if rows:
        yield packed(done())


def rename_fold(changes: DataFrame) -> DataFrame:
    """The changed files of each author, followed through the renames that this author made.

    A fold in order of time, as identities move with renames. Paths that renames connect form a component;
    each component is folded by itself, so one author with most of the changes is spread over many tasks.
    """
    node = F.concat_ws("\x1f", "repo_id", "author", "file_path")
    source = F.concat_ws("\x1f", "repo_id", "author", "previous_path")
    edges = changes.where("status = 'renamed' and previous_path is not null and previous_path <> file_path").select(source.alias("a"), node.alias("b")).distinct()
    roots = _components(edges)
    rooted = changes.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ordered = rooted.repartition("repo_id", "author", "root").sortWithinPartitions("repo_id", "author", "root", "commit_seq", "hash", "change_idx")
    return ordered.select("repo_id", "author", "root", "status", "file_path", "previous_path", "short_hash", "commit_date", "message").mapInArrow(_fold, _FOLDED)


def commit_summaries(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Commits with their distinct files in order of first mention."""
    first = changes_once(file_changes).groupBy("repo_id", "hash", "file_path").agg(F.min("change_idx").alias("at"))
    files = first.groupBy("repo_id", "hash").agg(F.array_sort(F.collect_list(F.struct("at", "file_path"))).alias("listed"))
    joined = delivered_once(commits).join(files, ["repo_id", "hash"], "left")
    listed = F.transform(F.coalesce("listed", F.array()), lambda x: x["file_path"])
    return joined.select("repo_id", "hash", "commit_seq", "author_name", "commit_date", F.size(listed).alias("file_count"), F.array_join(listed, "|").alias("files"))


def commit_totals(changes: DataFrame) -> DataFrame:
    """Files and added and deleted lines of each commit, from changes with line counts."""
    return changes.groupBy("repo_id", "hash").agg(F.countDistinct("file_path").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("deletions"))


def recent_commits(commits: DataFrame, most: int = 20) -> DataFrame:
    """The newest commits of each repository."""
    newest = Window.partitionBy("repo_id").orderBy(F.desc("commit_seq"), "hash")
    return delivered_once(commits).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most).select("repo_id", "place", "hash", "commit_seq", "commit_date")
