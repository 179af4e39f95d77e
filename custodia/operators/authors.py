"""Operators on authors and what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions.history import author_key, is_author, risk_level, risk_points, risk_reasons, risk_weight
from custodia.functions.paths import business_area, is_critical, normal_path
from custodia.operators.history import delivered_once


def commit_counts(commits: DataFrame) -> DataFrame:
    """Commits of each author of a repository, by address."""
    return delivered_once(commits).groupBy("repo_id", author_key(F.col("author_email")).alias("author")).agg(F.count(F.lit(1)).alias("commit_count"), F.min("commit_seq").alias("first_seq"), F.max("commit_seq").alias("last_seq"))


def commits_of(commits: DataFrame, target: str) -> DataFrame:
    """The commits of one author, named by address, name or both."""
    return delivered_once(commits).where(is_author(target, F.col("author_name"), F.col("author_email")))


def files_once(changed_files: DataFrame) -> DataFrame:
    """Changed files without repeated deliveries, with author keys and normal paths."""
    return changed_files.where("file_path is not null").select("repo_id", author_key(F.col("author_email")).alias("author"), normal_path(F.col("file_path")).alias("file_path"), "change_count", "additions", "deletions", "last_commit_date", "status", "file_exists", "module_name", "file_language").distinct()


def with_risk(files: DataFrame) -> DataFrame:
    """Changed files with the number of risk reasons and the level."""
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    points = risk_points(F.col("change_count"), lines, F.col("status") == "deleted", F.col("status") == "renamed", is_critical(F.col("file_path")))
    return files.withColumn("risk_points", points).withColumn("risk", risk_level(F.col("risk_points"), F.col("change_count"), lines))


def with_reasons(files: DataFrame) -> DataFrame:
    """Changed files with the reasons for their risk."""
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    return files.withColumn("reasons", risk_reasons(F.col("change_count"), lines, F.col("status") == "deleted", F.col("status") == "renamed", is_critical(F.col("file_path"))))


def contributions(files: DataFrame, by: str) -> DataFrame:
    """Files, changes and lines of each author by one attribute; a missing value is Unknown."""
    key = F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit("Unknown"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.groupBy("repo_id", "author", key.alias("name")).agg(F.count(F.lit(1)).alias("file_count"), total("change_count").alias("change_count"), total("additions").alias("additions"), total("deletions").alias("deletions"))


def present_first() -> Column:
    """Unknown files count as present."""
    return F.coalesce("file_exists", F.lit(True)).cast("int")


def ranked_files(files: DataFrame, most: int) -> DataFrame:
    """The first files of each author: present ones, then by risk, changes and path."""
    order = Window.partitionBy("repo_id", "author").orderBy(F.desc("present"), F.desc("weight"), F.desc_nulls_last("change_count"), "file_path", "status", "additions", "deletions", "last_commit_date", "module_name", "file_language", "file_exists")
    ranked = files.withColumn("present", present_first()).withColumn("weight", risk_weight(F.col("risk"))).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most)


def area_files(files: DataFrame, areas: int = 12, each: int = 5) -> DataFrame:
    """The most changed business areas of each repository and the most changed files in them."""
    summed = files.groupBy("repo_id", business_area(F.col("file_path")).alias("area"), "file_path").agg(F.coalesce(F.sum("change_count"), F.lit(0)).cast("long").alias("changes"))
    totals = summed.groupBy("repo_id", "area").agg(F.sum("changes").alias("area_changes"), F.count(F.lit(1)).alias("file_count"))
    by_area = Window.partitionBy("repo_id").orderBy(F.desc("area_changes"), "area")
    top = totals.withColumn("area_place", F.row_number().over(by_area)).where(F.col("area_place") <= areas)
    by_file = Window.partitionBy("repo_id", "area").orderBy(F.desc("changes"), "file_path")
    best = summed.withColumn("file_place", F.row_number().over(by_file)).where(F.col("file_place") <= each)
    return best.join(top, ["repo_id", "area"]).select("repo_id", "area_place", "area", "area_changes", "file_count", "file_place", "file_path", "changes")


def details(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Totals of each author: from changed files and from commits, which may cover different times."""
    own = files.groupBy("repo_id", "author").agg(F.countDistinct("file_path").alias("file_count"), F.coalesce(F.sum("change_count"), F.lit(0)).cast("long").alias("change_count"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("deletions"))
    order = F.struct("commit_seq", "hash")
    made = delivered_once(commits).withColumn("author", author_key(F.col("author_email"))).groupBy("repo_id", "author").agg(F.count(F.lit(1)).alias("commit_count"), F.min_by("commit_date", order).alias("first_date"), F.max_by("commit_date", order).alias("last_date"))
    return own.join(made, ["repo_id", "author"], "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0)).cast("long"))
