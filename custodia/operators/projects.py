"""Manifests, package managers, start commands and hints of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import paths
from custodia.functions.text import manifest_facts

# Lock files by package manager in order of preference, scripts that start a project in order, commands that manifests and files imply.
LOCK_FILES = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm")]
SCRIPTS = ["dev", "start", "serve", "preview", "build", "test"]
DECLARED = [
    ("gemfile", "", "bundle install"), ("gemfile", r"(?:^|\n)\s*gem\s+['\"]rails['\"]", "bundle exec rails server"), ("pubspec.yaml", "", "flutter pub get"), ("pubspec.yaml", "", "flutter run"), ("mix.exs", "", "mix deps.get"),
    ("mix.exs", ":phoenix|Phoenix", "mix phx.server"), ("mix.exs", "!:phoenix|Phoenix", "mix run"), ("package.swift", "", "swift run"), ("podfile", "", "pod install"),
]
IMPLIED = [("artisan", "php artisan serve"), ("manage.py", "python manage.py runserver"), ("main.py", "python main.py"), ("go.mod", "go run ."), ("cargo.toml", "cargo run"), ("pubspec.yaml", "flutter run"), ("mix.exs", "mix run"), ("makefile", "make")]
SETTINGS = r"application\.(?:properties|ya?ml)$"


def _nested(directory: Column, command: Column) -> Column:
    return F.when(directory == "", command).otherwise(F.concat(F.lit("cd "), directory, F.lit(" && "), command))


def manifests(files: DataFrame) -> DataFrame:
    """Manifest files with what they declare and the package manager of their folder. ``files`` has repo_id, file_path, content; a broken manifest is left out."""
    name = paths.file_name(F.col("file_path"))
    facts = manifest_facts(F.col("content"), name)
    found = files.where(paths.is_manifest(F.col("file_path"))).select("repo_id", "file_path", paths.directory(F.col("file_path")).alias("directory"), facts.alias("facts"), "content").where("facts is not null")
    found = found.select("repo_id", "file_path", "directory", "facts.*", "content").dropDuplicates(["repo_id", "file_path"])
    rank = F.lit(None).cast("int")
    for k, (lock, _) in reversed(list(enumerate(LOCK_FILES))):
        rank = F.when(name == lock, F.lit(k)).otherwise(rank)
    locks = files.select("repo_id", "file_path", rank.alias("rank")).where("rank is not null").groupBy("repo_id", paths.directory(F.col("file_path")).alias("directory")).agg(F.min("rank").alias("rank"))
    managers = F.array(*(F.lit(m) for _, m in LOCK_FILES))
    joined = found.join(locks, ["repo_id", "directory"], "left")
    return joined.withColumn("manager", F.when(F.col("ecosystem") == "Node.js", F.coalesce(F.element_at(managers, F.col("rank") + 1), F.lit("npm"))).otherwise(F.col("manager"))).drop("rank")


def start_commands(files: DataFrame) -> DataFrame:
    """Distinct start commands of each repository: those of manifests in their order, then what files imply together."""
    held = manifests(files)
    order = F.array(*(F.lit(s) for s in SCRIPTS))
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    named = held.where("ecosystem = 'Node.js'").select("repo_id", "directory", "manager", F.explode(F.filter(order, lambda s: F.try_element_at(scripts, s).isNotNull())).alias("script"))
    named = named.withColumn("ordinal", F.array_position(order, F.col("script")).cast("int") - 1)
    run = F.when(F.col("manager").isin("npm", "bun"), F.concat_ws(" ", F.col("manager"), F.lit("run"), F.col("script"))).otherwise(F.concat_ws(" ", F.col("manager"), F.col("script")))
    own = named.select("repo_id", F.lit(0).alias("part"), "directory", "ordinal", _nested(F.col("directory"), run).alias("command"))
    tests = [F.when((F.lower(paths.file_name(F.col("file_path"))) == name) & (F.lit(True) if not needle else ~F.col("content").rlike(needle[1:]) if needle[0] == "!" else F.col("content").rlike(needle)), F.struct(F.lit(10 + k).alias("ordinal"), F.lit(command).alias("bare"))) for k, (name, needle, command) in enumerate(DECLARED)]
    declared = held.select("repo_id", "directory", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("repo_id", F.lit(0).alias("part"), "directory", "x.ordinal", _nested(F.col("directory"), F.col("x.bare")).alias("command"))
    low = F.lower("file_path")
    rules = F.broadcast(files.sparkSession.createDataFrame([(p, k, c) for k, (p, c) in enumerate(IMPLIED)], "low string, ordinal int, command string"))
    implied = files.select("repo_id", low.alias("low")).join(rules, "low").select("repo_id", F.lit(1).alias("part"), F.lit("").alias("directory"), "ordinal", "command")
    # two conditions: a build file at the root and settings of an application anywhere
    both = files.groupBy("repo_id").agg(F.bool_or(low.rlike(SETTINGS)).alias("settings"), F.bool_or(low == "pom.xml").alias("maven"), F.bool_or(low.isin("build.gradle", "build.gradle.kts")).alias("gradle")).where("settings")
    booted = both.select("repo_id", F.lit(1).alias("part"), F.lit("").alias("directory"), F.explode(F.array_compact(F.array(F.when(F.col("maven"), F.struct(F.lit(20).alias("ordinal"), F.lit("mvn spring-boot:run").alias("command"))), F.when(F.col("gradle"), F.struct(F.lit(21).alias("ordinal"), F.lit("./gradlew bootRun").alias("command")))))).alias("x")).select("repo_id", "part", "directory", "x.*")
    dotnet = held.where("ecosystem = '.NET NuGet'").select("repo_id", F.lit(1).alias("part"), F.lit("").alias("directory"), F.lit(30).alias("ordinal"), F.concat(F.lit("dotnet run --project "), F.col("file_path")).alias("command"))
    union = own.unionByName(declared).unionByName(implied).unionByName(booted).unionByName(dotnet)
    return union.groupBy("repo_id", "command").agg(F.min(F.struct("part", "directory", "ordinal")).alias("o")).select("repo_id", "o.part", "o.ordinal", "command")


def author_hints(files: DataFrame) -> DataFrame:
    """What the one who takes over from an author should look at, as codes. ``files`` has risk and normal paths."""
    path = F.col("file_path")
    tests = {
        "risky_files": F.col("risk") == "high", "migrations": path.contains("migrations/"), "configuration": paths.is_config(path), "routes": path.startswith("routes/") | path.contains("router"),
        "background_jobs": F.lower(path).contains("jobs/") | F.lower(path).contains("commands/"), "deleted_files": F.col("status") == "deleted", "renamed_files": F.col("status") == "renamed",
    }
    flags = files.groupBy("repo_id", "author").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in tests.items()))
    return flags.select("repo_id", "author", F.array_join(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in tests))), ",").alias("hints"))
