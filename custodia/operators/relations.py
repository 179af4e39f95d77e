"""Imports, calls, types and the edges between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.functions.paths import directory
from custodia.functions.text import import_kind
from custodia.rules.files import IMPORT_EXTENSIONS

#: Patterns of imports, declared functions and types by language; group 1 is what is named.
IMPORTS = {
    "Python": r"(?m)^\s*(?:from|import) ([A-Za-z_][A-Za-z0-9_.]*)",
    "JavaScript": r"(?m)^import [^'\"\n]*['\"]([^'\"\n]+)['\"]",
    "TypeScript": r"(?m)^import [^'\"\n]*['\"]([^'\"\n]+)['\"]",
    "Java": r"(?m)^import (?:static )?([A-Za-z_][A-Za-z0-9_.*]*);",
    "PHP": r"(?m)^use ([A-Za-z_][A-Za-z0-9_\\]*);",
    "Go": r"(?m)^\t\"([^\"\n]+)\"\r?$",
}
FUNCTIONS = {
    "Python": r"(?m)^\s*(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)",
    "JavaScript": r"(?m)^(?:export )?(?:async )?function ([A-Za-z_][A-Za-z0-9_]*)",
    "TypeScript": r"(?m)^(?:export )?(?:async )?function ([A-Za-z_][A-Za-z0-9_]*)",
    "Java": r"(?m)^ +(?:public |private |protected |static )*[A-Za-z_][A-Za-z0-9_<>, ]* ([A-Za-z_][A-Za-z0-9_]*)\([^;\n]*$",
    "PHP": r"(?m)^\s*(?:public |private |protected |static )*function ([A-Za-z_][A-Za-z0-9_]*)",
    "Go": r"(?m)^func (?:\([^)\n]*\) )?([A-Za-z_][A-Za-z0-9_]*)",
}
TYPES = r"(?m)^(?:export |public |abstract |final )*class ([A-Za-z_][A-Za-z0-9_]*)(?:[ (]|$)"
BASES = r"(?m)^(?:export |public |abstract |final )*class [A-Za-z_][A-Za-z0-9_]*(?: extends |\()([A-Za-z_][A-Za-z0-9_]*)"
CALLS = r"[A-Za-z0-9_)]\.([a-z][A-Za-z0-9]*)\("


def _by_language(table: dict[str, str]):
    out = F.array().cast("array<string>")
    for language, pattern in table.items():
        out = F.when(F.col("file_language") == language, F.regexp_extract_all("content", F.lit(pattern), 1)).otherwise(out)
    return out


def sources(source_files: DataFrame) -> DataFrame:
    """The columns that extraction reads. Repeated deliveries are dropped from what is extracted, so texts are never shuffled."""
    return source_files.select("file_id", "repo_id", "file_path", "file_language", "content")


def imports(files: DataFrame) -> DataFrame:
    """Distinct imports of each file, in order, with their kind."""
    found = files.select("repo_id", "file_path", "file_language", F.posexplode(F.array_distinct(_by_language(IMPORTS))).alias("ordinal", "import_path")).distinct()
    return found.withColumn("kind", import_kind(F.col("import_path")))


def symbols(files: DataFrame) -> DataFrame:
    """Distinct functions and types that each file declares."""
    functions = files.select("repo_id", "file_path", F.lit("function").alias("kind"), F.posexplode(F.array_distinct(_by_language(FUNCTIONS))).alias("ordinal", "name"))
    types = files.select("repo_id", "file_path", F.lit("class").alias("kind"), F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(TYPES), 1))).alias("ordinal", "name"))
    return functions.unionByName(types).distinct()


def calls(files: DataFrame) -> DataFrame:
    """Distinct names that each file calls on something."""
    return files.select("repo_id", "file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALLS), 1))).alias("call")).distinct()


def inheritance(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(BASES), 1))).alias("base")).distinct()


def joined_path(folder, relative):
    """``relative`` taken from ``folder``, without ``.`` and ``..``; null if it leaves the root."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), relative), "/")
    kept = F.aggregate(
        parts,
        F.array(F.lit("")),
        lambda held, part: F.when(held.isNull() | (part == ".") | (part == ""), held).when(part == "..", F.when(F.size(held) > 1, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1))))).otherwise(F.concat(held, F.array(part))),
    )
    return F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), "/")


def resolved_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports with the file they mean: of the ordered candidates the first that exists, without regard to case."""
    base = joined_path(directory(F.col("file_path")), F.col("import_path"))
    suffixes = [x for e in IMPORT_EXTENSIONS for x in ((e,) if e == "" else (e, f"/index{e}"))]
    wanted = imported.where("kind = 'relative'").withColumn("base", base).where("base is not null")
    candidates = wanted.select("repo_id", "file_path", "import_path", "base", F.posexplode(F.array(*(F.lit(s) for s in suffixes))).alias("place", "suffix")).withColumn("low", F.lower(F.concat("base", "suffix")))
    held = files.select("repo_id", "file_path").groupBy("repo_id", F.lower("file_path").alias("low")).agg(F.min("file_path").alias("to_file"))
    found = candidates.join(held, ["repo_id", "low"]).groupBy("repo_id", "file_path", "import_path").agg(F.min_by("to_file", "place").alias("to_file"))
    return wanted.select("repo_id", "file_path", "import_path").distinct().join(found, ["repo_id", "file_path", "import_path"], "left")


def call_edges(called: DataFrame, declared: DataFrame) -> DataFrame:
    """Calls with the file that declares the name, where exactly one file of the repository does."""
    targets = declared.where("kind = 'function'").groupBy("repo_id", F.lower("name").alias("low")).agg(F.min("file_path").alias("to_file"), F.max("file_path").alias("last")).where("to_file = last").select("repo_id", "low", "to_file")
    return called.withColumn("low", F.lower("call")).join(targets, ["repo_id", "low"], "left").select("repo_id", "file_path", "call", "to_file")


def relation_counts(imported: DataFrame, called: DataFrame, inherited: DataFrame) -> DataFrame:
    """Edges of each repository by kind."""
    one = lambda df, kind: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges")).withColumn("kind", F.lit(kind))
    return one(imported, "import").unionByName(one(called, "call")).unionByName(one(inherited, "inheritance"))


def analysis_totals(ast_files: DataFrame) -> DataFrame:
    """Analysed files, symbols and languages of each repository, and whether any was read by the fallback."""
    language = F.initcap(F.trim("file_language"))
    once = ast_files.distinct()
    return once.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("symbol_count"), F.lit(0)).cast("long").alias("symbols"), F.countDistinct(F.lower(language)).alias("languages"), F.max((F.col("engine") == "static-fallback").cast("int")).alias("fallback"))
