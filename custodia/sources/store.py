"""The store of recent projects, a JSON file of few rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.operators.scope import upserted

SCHEMA = "path string, name string, language string, document string, opened_at timestamp"


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The projects; none if the file is missing or broken."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("path is not null")


def with_project(held: DataFrame, new: DataFrame, most: int = 20) -> DataFrame:
    """The store after projects were opened: each path once, the newest first."""
    return upserted(held, new, "path", "opened_at", most)


def without_project(held: DataFrame, path: str) -> DataFrame:
    return held.where(F.col("path") != path)


def write_projects(projects: DataFrame, folder: str) -> None:
    projects.write.mode("overwrite").json(folder)
