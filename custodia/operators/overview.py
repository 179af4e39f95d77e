"""Overviews of projects and persons, and the texts that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions.history import risk_weight
from custodia.functions.paths import is_config, top_directory
from custodia.operators.authors import present_first

#: The label of a language, by what its name holds; the first that fits holds.
LABELS = [("vue", "V"), ("typescript", "TS"), ("java", "J"), ("php", "P"), ("go", "Go"), ("python", "Py"), ("javascript", "JS")]
#: Months back from today that a range of dates may be named by.
PRESETS = {"3m": 3, "6m": 6, "12m": 12}


def project_name(path: Column) -> Column:
    """The last segment of a path with slashes of either kind."""
    return F.element_at(F.filter(F.split(path, r"[/\\]"), lambda x: x != ""), -1)


def language_label(language: Column) -> Column:
    out = F.coalesce(F.nullif(F.upper(F.substring(language, 1, 2)), F.lit("")), F.lit("?"))
    for part, label in reversed(LABELS):
        out = F.when(F.lower(language).contains(part), F.lit(label)).otherwise(out)
    return out


def range_text(first: Column, last: Column) -> Column:
    """Two dates as a range, one if they are equal or only one is known, a dash if none is."""
    return F.when(first.isNull() & last.isNull(), F.lit("-")).when(F.coalesce(first == last, F.lit(True)), F.coalesce(first, last)).otherwise(F.concat(first, F.lit(" to "), last))


def state_text(exists: Column, status: Column) -> Column:
    return F.when(~F.coalesce(exists, F.lit(True)), F.lit("no longer there")).when(status == "renamed", F.lit("there, renamed")).otherwise(F.lit("there"))


def failure_reason(message: Column, most: int = 180) -> Column:
    """Why a file could not be read, on one line of at most ``most`` characters and three dots."""
    line = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(F.coalesce(F.nullif(line, F.lit("")), F.lit("unknown")))


def since(preset: str, today: Column | None = None) -> Column:
    """The first day of a named range of dates."""
    return F.add_months(F.current_date() if today is None else today, -PRESETS[preset])


def in_range(df: DataFrame, day: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows whose day lies in the range; both ends belong to it, an end that is missing is open, days that are none are left out."""
    held = F.to_date(F.try_to_timestamp(day))
    out = df.where(held.isNotNull())
    out = out if first is None else out.where(held >= first)
    return out if last is None else out.where(held <= last)


def visible_directories(files: DataFrame, most: int = 50) -> DataFrame:
    """Top-level directories without leading dot, and how many files lie below each."""
    counts = files.groupBy("repo_id", top_directory(F.col("file_path")).alias("directory")).agg(F.count(F.lit(1)).alias("file_count")).where("directory is not null and not startswith(directory, '.')")
    order = Window.partitionBy("repo_id").orderBy(F.desc("file_count"), "directory")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_counts(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Listed directories with the number of their files; 0 for those that hold none."""
    counts = files.groupBy("repo_id", top_directory(F.col("file_path")).alias("directory")).agg(F.count(F.lit(1)).alias("file_count"))
    return directories.join(counts, ["repo_id", "directory"], "left").na.fill(0, ["file_count"])


def fallback_histogram(files: DataFrame) -> DataFrame:
    """Files by language without the unknown ones, with whole percentages; for projects whose scan gave none."""
    counts = files.where("language is not null and language <> 'Unknown'").groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("file_count"))
    return counts.withColumn("percent", F.round(F.col("file_count") * 100 / F.sum("file_count").over(Window.partitionBy("repo_id"))).cast("int"))


def personal_order(files: DataFrame, most: int = 60) -> DataFrame:
    """The first files of each author: present ones, then by changes, then by risk and path."""
    order = Window.partitionBy("repo_id", "author").orderBy(F.desc(present_first()), F.desc_nulls_last("change_count"), F.desc(risk_weight(F.col("risk"))), "file_path", "status", "additions", "deletions", "last_commit_date", "module_name", "file_language", "file_exists")
    return files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def config_files(modules: DataFrame, changed: DataFrame) -> DataFrame:
    """Configuration files of a repository: those that modules list come first, else changed files that are one by their name."""
    listed = modules.where("module_type = 'config' and files is not null").select("repo_id", F.explode("files").alias("file_path")).withColumn("part", F.lit(0))
    named = changed.where(is_config(F.col("file_path"))).select("repo_id", "file_path").withColumn("part", F.lit(1))
    first = Window.partitionBy("repo_id")
    held = listed.unionByName(named).distinct().withColumn("best", F.min("part").over(first))
    return held.where("part = best").select("repo_id", "file_path", "part").distinct()


def start_command(commands: DataFrame, languages: DataFrame) -> DataFrame:
    """One start command a repository: the first that is known, else the usual one of its main language, else none."""
    usual = F.create_map(*(F.lit(x) for pair in (("Go", "go run ."), ("Python", "python main.py"), ("Java", "mvn spring-boot:run"), ("PHP", "php -S localhost:8000"), ("JavaScript", "npm start"), ("TypeScript", "npm start")) for x in pair))
    known = commands.groupBy("repo_id").agg(F.min(F.struct("part", "ordinal", "command"))["command"].alias("known"))
    main = languages.groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("file_count"), F.col("language"))).alias("language"))
    return main.join(known, "repo_id", "full").select("repo_id", F.coalesce("known", F.try_element_at(usual, F.col("language")), F.lit("-")).alias("command"))
