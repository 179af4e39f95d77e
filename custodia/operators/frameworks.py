"""Framework detection and module scan over the rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custodia.functions.paths import directory, extension
from custodia.rules.frameworks import ANY_VERBS, ENTRIES, GENERIC_MODULES, INDICATORS, MODULES, PATTERN_INDICATORS, REGISTRY, THRESHOLDS


def indicator_table(spark: SparkSession) -> DataFrame:
    rows = [(i.framework, REGISTRY.index(i.framework), i.ordinal, i.path, list(i.needles), i.weight, THRESHOLDS[i.framework]) for i in INDICATORS]
    return spark.createDataFrame(rows, "framework string, registry int, ordinal int, path string, needles array<string>, weight int, threshold int")


def module_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in MODULES], "framework string, ordinal int, name string, kind string, directory string, endings string")


def parent_directories(files: DataFrame) -> DataFrame:
    """Every directory that holds a file, near or far, with a slash at its end."""
    parts = F.split(directory(F.col("file_path")), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return files.where(F.col("file_path").contains("/")).select("repo_id", F.explode(every).alias("path")).distinct()


def framework_scores(files: DataFrame) -> DataFrame:
    """Frameworks of each repository whose satisfied indicators reach the threshold; at most 100, with the evidence.

    ``files`` has repo_id, file_path and content. The rules are a fixed table of some hundred rows and are
    broadcast; contents are read only of files that a rule with needles names.
    """
    rules = F.broadcast(indicator_table(files.sparkSession))
    folders = parent_directories(files).join(rules.where("endswith(path, '/')"), "path")
    named = files.select("repo_id", F.col("file_path").alias("path"), "content").join(rules.where("not endswith(path, '/')"), "path")
    hits = named.where((F.size("needles") == 0) | F.exists("needles", lambda n: F.contains(F.coalesce("content", F.lit("")), n)))
    columns = ["repo_id", "framework", "registry", "ordinal", "path", "weight", "threshold"]
    tests = [F.when(F.col("file_path").rlike(p) & (F.lit(True) if not needle else F.coalesce(F.col("content").rlike(needle), F.lit(False))), F.struct(F.lit(framework).alias("framework"), F.lit(REGISTRY.index(framework)).alias("registry"), F.lit(100 + k).alias("ordinal"), F.lit(weight).alias("weight"), F.lit(THRESHOLDS[framework]).alias("threshold"))) for k, (framework, p, needle, weight) in enumerate(PATTERN_INDICATORS)]
    patterned = files.select("repo_id", "file_path", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("repo_id", "file_path", "x.*")
    patterned = patterned.groupBy("repo_id", "framework", "registry", "ordinal", "weight", "threshold").agg(F.min("file_path").alias("path"))
    met = folders.select(columns).unionByName(hits.select(columns)).unionByName(patterned.select(columns)).distinct()
    scored = met.groupBy("repo_id", "framework", "registry", "threshold").agg(F.sum("weight").alias("points"), F.array_sort(F.collect_list(F.struct("ordinal", "path"))).alias("found"))
    reached = scored.where("points >= threshold")
    order = Window.partitionBy("repo_id").orderBy(F.desc("confidence"), "registry")
    return reached.withColumn("confidence", F.least("points", F.lit(100)).cast("int")).withColumn("place", F.row_number().over(order)).select("repo_id", "framework", "confidence", F.array_join(F.transform("found", lambda x: x["path"]), "|").alias("evidence"), "place")


def module_files(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """The files of each module of each repository's first framework."""
    first = frameworks.where("place = 1").select("repo_id", "framework")
    wanted = first.join(F.broadcast(module_table(files.sparkSession)), "framework")
    # a file lies in each of its parent directories, and in any directory, so the modules are joined on the directory
    parts = F.split(directory(F.col("file_path")), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    placed = files.select("repo_id", "file_path", F.explode(F.concat(F.array(F.lit("*")), every)).alias("directory")).where("directory <> ''")
    fits = (F.col("endings") == "") | F.array_contains(F.split("endings", " "), extension(F.col("file_path")))
    return placed.join(wanted, ["repo_id", "directory"]).where(fits).select("repo_id", "framework", "ordinal", "name", "kind", "file_path").distinct()


def generic_modules(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Modules of repositories without any in ``found``: well-known directories, then every other top-level directory."""
    top = F.split("file_path", "/")[0]
    known = F.create_map(*(F.lit(x) for name, kind in GENERIC_MODULES for x in (name, kind)))
    rest = files if found is None else files.join(found.select("repo_id").distinct(), "repo_id", "left_anti")
    placed = rest.where(F.col("file_path").contains("/") & ~F.col("file_path").startswith(".")).select("repo_id", "file_path", top.alias("name")).distinct()
    order = F.array(*(F.lit(name) for name, _ in GENERIC_MODULES))
    at = F.array_position(order, F.col("name"))
    return placed.select("repo_id", F.lit("Generic").alias("framework"), F.when(at > 0, at - 1).otherwise(F.lit(len(GENERIC_MODULES))).cast("int").alias("ordinal"), "name", F.coalesce(F.try_element_at(known, F.col("name")), F.lit("other")).alias("kind"), "file_path")


def module_entries(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Distinct routes, commands and tables in the files of repositories whose first framework knows such, as ``kind`` and ``entry``."""
    first = frameworks.where("place = 1").select("repo_id", "framework")
    pairs = F.array().cast("array<struct<kind:string,verb:string,path:string>>")
    line = F.col("line")
    for kind, framework, pattern in ENTRIES:
        hit = (F.col("framework") == framework) & line.rlike(pattern)
        pairs = F.concat(pairs, F.when(hit, F.array(F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("verb"), F.regexp_extract(line, pattern, 2).alias("path")))).otherwise(F.array().cast("array<struct<kind:string,verb:string,path:string>>")))
    lines = files.join(first, "repo_id").where(F.col("framework").isin(sorted({f for _, f, _ in ENTRIES}))).select("repo_id", "framework", "file_path", F.explode(F.split("content", "\r?\n")).alias("line"))
    found = lines.select("repo_id", "framework", "file_path", F.explode(pairs).alias("x")).select("repo_id", "framework", "file_path", "x.*")
    verb = F.upper(F.regexp_replace("verb", "^Http", ""))
    named = F.when(F.col("kind") == "route", F.concat_ws(" ", F.when(F.lower(verb).isin(ANY_VERBS), F.lit("ANY")).otherwise(verb), F.col("path"))).otherwise(F.col("path"))
    return found.select("repo_id", "framework", "file_path", "kind", named.alias("entry")).distinct()
