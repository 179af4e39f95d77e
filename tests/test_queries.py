"""Every query against its SQL in another engine, over the smallest tables."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(data):
        con.sql(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or isinstance(value, str):
        return repr(value)
    try:
        return repr(round(float(value), 6))
    except TypeError:
        return repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_sql(spark, other, data, name):
    df = QUERIES[name](spark, data)
    relation = other.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    places = [relation.columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[k]) for k in places) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_small_files_stay_in_the_whole_inventory(spark, tmp_path):
    sources = [(1, "r", "src/a.py", 20), (2, "r", "src/b.py", 9_000), (3, "r", "src/c.py", None)]
    spark.createDataFrame(sources, "file_id long, repo_id string, file_path string, size_bytes long").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([("r", ["src/A.py", "src/gone.py"]), ("r", None)], "repo_id string, files array<string>").write.parquet(f"{tmp_path}/modules.parquet")
    got = {tuple(r) for r in QUERIES["inventory_merge"](spark, str(tmp_path)).select("origin", "language", "file_count", "first_path").collect()}
    assert got == {("scanned", "Python", 3, "src/a.py"), ("added", "Unknown", 1, "src/gone.py")}
