"""What of a project belongs to one author, and unions in which one side comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def personal_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files that each author changed and that are still there, from ``changed`` of repo_id, author and file_path."""
    touched = changed.select("repo_id", "author", "file_path").where("author is not null").distinct()
    return files.select("repo_id", "file_path", "language", "size_bytes").join(touched, ["repo_id", "file_path"])


def personal_modules(modules: DataFrame, changed: DataFrame) -> DataFrame:
    """Modules with those of their files that each author changed; modules that become empty are left out."""
    touched = changed.select("repo_id", "author", "file_path").where("author is not null").distinct()
    listed = modules.where("files is not null").select("repo_id", "ordinal", "name", "module_type", F.posexplode(F.array_distinct("files")).alias("place", "file_path"))
    joined = listed.join(touched, ["repo_id", "file_path"])
    return joined.groupBy("repo_id", "author", "ordinal", "name", "module_type").agg(F.count(F.lit(1)).alias("file_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: x["file_path"]), "|").alias("files"))


def first_wins(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """The union of ``parts``; of rows with equal keys the one from the earliest part stays, then by ``order``."""
    union = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        union = union.unionByName(part.withColumn("_part", F.lit(k)))
    rank = Window.partitionBy(*keys).orderBy("_part", *order)
    return union.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank").withColumnRenamed("_part", "part")


def upserted(held: DataFrame, new: DataFrame, key: str, newest: str, most: int = 20) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those with the same key; the ``most`` newest stay."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(newest)))).where("_n = 1").drop("_n")
    merged = held.join(once.select(key), key, "left_anti").unionByName(once)
    return merged.orderBy(F.desc_nulls_last(newest), key).limit(most)
