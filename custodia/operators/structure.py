"""Declarations, imports, calls and types of source files, line by line.

Files become lines, narrow rows without a shuffle; a line becomes a declaration by the rules of its language, inside Spark's
own expressions. Only what lines declare is made distinct, so texts are never shuffled. The type a declaration lies in is
the last one above it if that has a smaller margin, else the last one that has none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.rules.structure import CALL, COMMENT_LINE, DECLARES, IMPORT_RULES, NO_CALLS, NO_NAMES, RULES, TYPE_KINDS


def lines(files: DataFrame) -> DataFrame:
    """``line_no`` from 1 and ``line`` of each file that is written in a known language, comment lines left out; in Vue files the lines of the scripts count."""
    known = files.where(F.col("file_language").isin(sorted({r.language for r in RULES})))
    # of a single-file component the script blocks, one after the other
    scripts = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1), "\n")
    text = F.when(F.col("file_language") == "Vue", scripts).otherwise(F.col("content"))
    split = known.select("file_id", "repo_id", "file_path", "file_language", F.posexplode(F.split(text, "\r?\n")).alias("place", "line"))
    return split.where(~F.col("line").rlike(COMMENT_LINE)).select("file_id", "repo_id", "file_path", "file_language", (F.col("place") + 1).alias("line_no"), "line")


def _rule_number(line: Column) -> Column:
    """The place in the table of the first rule of the file's language that fits a line, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for language in sorted({r.language for r in RULES}):
        chain = F.lit(None).cast("int")
        for place, rule in reversed([(k, r) for k, r in enumerate(RULES, 1) if r.language == language]):
            chain = F.when(line.rlike(rule.pattern), F.lit(place)).otherwise(chain)
        out = F.when(F.col("file_language") == language, chain).otherwise(out)
    return out


def _declaring(files: DataFrame) -> DataFrame:
    """Lines that declare something, with ``kind``, ``name``, and the texts of ``bases`` and ``interfaces``."""
    fitting = lines(files).withColumn("rule", _rule_number(F.col("line"))).where("rule is not null")
    column = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("rule"))
    kinds, patterns = column([r.kind for r in RULES]), column([r.pattern for r in RULES])
    groups = column([re.compile(r.pattern).groups for r in RULES])
    extracted = lambda g: F.call_function("regexp_extract", F.col("line"), patterns, F.lit(g))
    part = lambda g: F.when(groups >= g, F.nullif(F.trim(extracted(g)), F.lit("")))
    named = fitting.withColumns({"kind": kinds, "name": extracted(1), "bases": part(2), "interfaces": part(3)})
    spoken = F.col("kind").isin("method", "constructor") & (F.col("name").isin(NO_NAMES) | F.col("line").rlike(r"^\s*(?:return|throw|new|else|await|yield)\b"))
    return named.where(~spoken)


def _names(text: Column) -> Column:
    """The types in a list of them, without arguments, key words and blanks; ``a=b`` is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^<>]*>|\\([^()]*\\)", "")
    return F.filter(F.transform(F.split(bare, "[,&+]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:public|private|protected|virtual)\s+|\s+where\b.*$", ""))), lambda x: x.rlike(r"^[A-Za-z_$\\][A-Za-z0-9_$.\\:]*$"))


def visibility(language: Column, line: Column, name: Column) -> Column:
    """How far a declaration is seen, as its language says."""
    said = F.nullif(F.regexp_extract(line, r"^\s*(?:[a-z]+\s+)*?(public|protected|private|internal)\b", 1), F.lit(""))
    exported = line.rlike(r"^\s*export\b")
    return (
        F.when(language == "Python", F.when(name.startswith("_"), "private").otherwise("public"))
        .when(language == "Go", F.when(name.rlike("^[A-Z]"), "exported").otherwise("package"))
        .when(language == "Rust", F.when(line.rlike(r"^\s*pub\b"), "public").otherwise("private"))
        .when(language.isin("JavaScript", "TypeScript", "Vue"), F.when(exported, "exported").otherwise(F.coalesce(said, F.when(name.startswith("#"), "private").otherwise("local"))))
        .otherwise(F.coalesce(said, F.when(language == "Java", "package").otherwise("public")))
    )


def declarations(files: DataFrame) -> DataFrame:
    """Each declaration with its kind, line, the type it lies in, visibility, and what a type extends and implements.

    In Go the parent of a method is the type of its receiver. A function inside a type is a method. Interfaces that extend
    others extend them; a C# name that begins with I and a capital is an interface.
    """
    found = _declaring(files)
    rows = found.select("file_id", "repo_id", "file_path", "file_language", "line_no", "kind", "name", "bases", "interfaces", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("margin"), "line").distinct()
    holds = F.col("kind").isin(TYPE_KINDS)
    # the last type above if its margin is smaller, else the last one at the margin of the file
    above = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(holds, F.struct("margin", "name")), ignorenulls=True).over(above)
    outer = F.last(F.when(holds & (F.col("margin") == 0), F.col("name")), ignorenulls=True).over(above)
    inside = F.when(last["margin"] < F.col("margin"), last["name"]).when(F.col("margin") > 0, outer)
    receiver = F.nullif(F.regexp_extract("line", r"^func\s+\(\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)?\*?([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))
    placed = rows.withColumn("parent", F.when((F.col("file_language") == "Go") & (F.col("kind") == "method"), receiver).otherwise(inside))
    kind = F.when((F.col("kind") == "function") & F.col("parent").isNotNull() & ~F.col("file_language").isin("JavaScript", "TypeScript", "Vue"), F.lit("method")).otherwise(F.col("kind"))
    bases, interfaces = _names(F.col("bases")), _names(F.col("interfaces"))
    sharp, conventional = F.col("file_language") == "C#", lambda x: x.rlike("^I[A-Z]")
    return placed.select(
        "file_id", "repo_id", "file_path", "file_language", "line_no", kind.alias("kind"), "name", "parent", visibility(F.col("file_language"), F.col("line"), F.col("name")).alias("visibility"),
        F.when(sharp, F.filter(bases, lambda x: ~conventional(x))).otherwise(bases).alias("extends"), F.when(sharp, F.filter(bases, conventional)).otherwise(interfaces).alias("implements"),
    )


def type_edges(declared: DataFrame) -> DataFrame:
    """Inheritance and implementation edges: one row for each type that a declaration extends or implements."""
    extends = declared.select("repo_id", "file_path", "name", F.lit("inheritance").alias("kind"), F.explode("extends").alias("target"))
    implements = declared.select("repo_id", "file_path", "name", F.lit("implementation").alias("kind"), F.explode("implements").alias("target"))
    return extends.unionByName(implements).distinct()


def clean_import(path: Column) -> Column:
    """An import without decorations: a leading type or static, an alias, a semicolon at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(path), r"^(?:type|static|function|const)\s+", ""), r"\s*;\s*$|\s+as\s+.*$", ""))


def imported(files: DataFrame) -> DataFrame:
    """Distinct imports of each file, with the line of the first: ``module`` or ``module::name`` for names taken from one."""
    line = F.col("line")
    out = F.array().cast("array<string>")
    for language, pattern, several in reversed(IMPORT_RULES):
        head, tail = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
        each = F.filter(F.transform(F.split(tail, ","), clean_import), lambda x: x != "") if several else F.array(clean_import(head))
        named = F.transform(each, lambda x: F.when(head == "", x).otherwise(F.concat(head, F.lit("::"), x))) if several else each  # noqa: B023
        out = F.when((F.col("file_language") == language) & line.rlike(pattern), named).otherwise(out)
    rows = lines(files).select("file_id", "repo_id", "file_path", "file_language", "line_no", F.explode(out).alias("import_path"))
    return rows.groupBy("file_id", "repo_id", "file_path", "file_language", "import_path").agg(F.min("line_no").alias("line_no"))


def called(files: DataFrame) -> DataFrame:
    """Distinct calls of each file, with what they are called on."""
    found = F.regexp_extract_all("line", F.lit(CALL), 1)
    rows = lines(files).where(~F.col("line").rlike(DECLARES)).select("file_id", "repo_id", "file_path", F.explode(found).alias("call"))
    return rows.where(~F.col("call").isin(NO_CALLS)).distinct()


def analysis(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Totals of each repository: analysed and skipped files, symbols, imports, calls, and its languages in order.

    ``analysed`` are the files that were read; those of a known language in ``files`` that are not among them were skipped.
    """
    supported = files.where(F.col("file_language").isin(sorted({r.language for r in RULES}))).select("repo_id", "file_id", "file_language").distinct()
    read = analysed.select("file_id").distinct().withColumn("read", F.lit(1))
    heads = supported.join(read, "file_id", "left").groupBy("repo_id").agg(F.count("read").alias("files"), F.count(F.when(F.col("read").isNull(), 1)).alias("skipped"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("read").isNotNull(), F.col("file_language")))), ",").alias("languages"))
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    out = heads
    for df, name in ((declarations(analysed), "symbols"), (imported(analysed), "imports"), (called(analysed), "calls")):
        out = out.join(count(df, name), "repo_id", "left")
    return out.na.fill(0, ["symbols", "imports", "calls"])


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files of each repository by path; a limit for one project, to be left out for many."""
    order = Window.partitionBy("repo_id").orderBy("file_path", "file_id")
    kept = files.select("file_id", "repo_id", "file_path").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return files.join(kept.select("file_id"), "file_id", "left_semi")


def display_names(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Call edges with the name of the target: ``parent::name`` where the first declaration of that name in the file has a parent."""
    first = declared.groupBy("repo_id", F.col("file_path").alias("to_file"), F.col("name").alias("callee")).agg(F.min_by("parent", "line_no").alias("parent"))
    joined = edges.withColumn("callee", F.regexp_extract("call", r"([A-Za-z0-9_$]*)!?$", 1)).join(first, ["repo_id", "to_file", "callee"], "left")
    return joined.select("repo_id", "file_path", "call", "to_file", F.concat_ws("::", "parent", "callee").alias("target"))


def edges_within(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges that begin in an allowed file; where they lead to is not looked at."""
    return edges.join(allowed.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
