"""Every registered query of the core and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custodia.plans import histories, overviews, reports, sources, structure, trees

Query = Callable[[SparkSession, str], DataFrame]
ALL = histories.QUERIES | trees.QUERIES | sources.QUERIES | structure.QUERIES | overviews.QUERIES | reports.QUERIES


def _long(query: Query) -> Query:
    """The query with its whole numbers as longs, so that both sides of a comparison have one type."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind == "int"})

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _long(query) for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
