"""Operators on the files of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions import paths
from custodia.rules.files import LARGEST_INVENTORY_FILE


def inventory(source_files: DataFrame) -> DataFrame:
    """One row a file: name, extension, language and size; repeated deliveries once. The contents are not read."""
    path = F.col("file_path")
    return source_files.select("file_id", "repo_id", "file_path", "size_bytes").distinct().select("*", paths.file_name(path).alias("name"), paths.extension(path).alias("extension"), paths.language(path).alias("language"))


def scanned(files: DataFrame, extensions: list[str] | None = None, largest: int = LARGEST_INVENTORY_FILE) -> DataFrame:
    """What an inventory holds: no ignored directories, binary, sensitive or large files."""
    path = F.col("file_path")
    kept = files.where(~paths.is_binary(path) & ~paths.in_ignored_directory(path) & ~paths.is_sensitive(path) & (F.coalesce("size_bytes", F.lit(0)) <= largest))
    return kept.where(paths.extension(path).isin(extensions)) if extensions else kept


def language_histogram(files: DataFrame) -> DataFrame:
    """Files by language with the share of all recognised ones and the extensions found."""
    known = files.where("language is not null")
    counts = known.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("file_count"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("extension") == "", F.col("name")).otherwise(F.col("extension")))), ",").alias("extensions"))
    return counts.withColumn("percentage", F.col("file_count") * 100.0 / F.sum("file_count").over(Window.partitionBy("repo_id")))


def raised_histogram(files: DataFrame, touched: DataFrame) -> DataFrame:
    """Files by language, each language of a touched file counting at least once."""
    held = files.where("language is not null").groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n"))
    used = touched.select("repo_id", F.col("file_language").alias("language")).where("language is not null").distinct().withColumn("used", F.lit(1))
    return held.join(used, ["repo_id", "language"], "full").select("repo_id", "language", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("used", F.lit(0))).cast("long").alias("file_count"))


def top_directories(files: DataFrame, most: int = 50) -> DataFrame:
    """The top-level directories of each repository by number of files."""
    counts = files.withColumn("directory", paths.top_directory(F.col("file_path"))).where("directory is not null").groupBy("repo_id", "directory").agg(F.count(F.lit(1)).alias("file_count"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("file_count"), "directory")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def merged_inventory(files: DataFrame, key_files: DataFrame) -> DataFrame:
    """The files and the key files not among them; names are compared without case."""
    lower = F.lower("file_path")
    known = files.select("repo_id", lower.alias("low")).distinct()
    first = key_files.groupBy("repo_id", lower.alias("low")).agg(F.min("file_path").alias("file_path"))
    added = first.join(known, ["repo_id", "low"], "left_anti").select("repo_id", "file_path", F.lit("Unknown").alias("language"), F.lit("added").alias("origin"))
    return files.select("repo_id", "file_path", F.coalesce("language", F.lit("Unknown")).alias("language"), F.lit("scanned").alias("origin")).unionByName(added)


def key_files(files: DataFrame, each: int = 5, most: int = 50) -> DataFrame:
    """The largest files of each directory, at most ``most`` of a repository."""
    by_directory = Window.partitionBy("repo_id", "directory").orderBy(F.desc("size_bytes"), "file_path")
    largest = files.withColumn("directory", paths.directory(F.col("file_path"))).withColumn("rank", F.row_number().over(by_directory)).where(F.col("rank") <= each)
    overall = Window.partitionBy("repo_id").orderBy("directory", "rank")
    return largest.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= most).select("repo_id", "place", "directory", "rank", "file_path", "size_bytes")


def within(files: DataFrame, root: str, extensions: list[str], depth: int = 4) -> DataFrame:
    """Files below ``root`` with one of the extensions, at most ``depth`` directories down."""
    inside = F.when(F.lit(root) == "", F.col("file_path")).otherwise(F.substring("file_path", len(root) + 2, 10_000))
    under = F.lit(root == "") | F.col("file_path").startswith(root.rstrip("/") + "/")
    return files.where(under & (F.size(F.split(inside, "/")) - 1 <= depth) & paths.extension(F.col("file_path")).isin(extensions))


def with_existence(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files with a flag that tells whether the working tree holds them."""
    held = files.select("repo_id", "file_path").distinct().withColumn("held", F.lit(True))
    return changed.join(held, ["repo_id", "file_path"], "left").withColumn("exists_now", F.col("held").isNotNull()).drop("held")


def path_flags(files: DataFrame) -> DataFrame:
    """What each path is by its name alone."""
    path = F.col("file_path")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = {"sensitive": paths.is_sensitive, "config": paths.is_config, "document": paths.is_document, "readme": paths.is_readme, "manifest": paths.is_manifest, "critical": paths.is_critical, "ignored": paths.in_ignored_directory, "source": paths.is_handover_source}
    return files.select("repo_id", "file_path", *(flag(f(path)).alias(name) for name, f in flags.items()))


def sensitive_paths(files: DataFrame, most: int = 50) -> DataFrame:
    """The first sensitive paths of each repository in order of their names; contents are not read."""
    held = files.select("repo_id", "file_path").where(paths.is_sensitive(F.col("file_path"))).distinct()
    order = Window.partitionBy("repo_id").orderBy("file_path")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """The top-level directories of each repository whose name ends with ``suffix``."""
    top = paths.top_directory(F.col("file_path"))
    return files.select("repo_id", top.alias("directory")).where(F.col("directory").endswith(suffix)).distinct()


def first_below(files: DataFrame, directory: str, most: int = 50) -> DataFrame:
    """The first files of each repository below a directory, by path; what ignored directories hold is left out."""
    held = files.where(F.col("file_path").startswith(f"{directory}/") & ~paths.in_ignored_directory(F.col("file_path"))).select("repo_id", "file_path").distinct()
    order = Window.partitionBy("repo_id").orderBy("file_path")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
