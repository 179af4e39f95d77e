from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from custodia.operators import overview


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_texts(spark):
    assert [one(spark, overview.project_name(F.lit(p))) for p in ("/a/b/", "C:\\\\x\\\\shop", "solo")] == ["b", "shop", "solo"]
    assert [one(spark, overview.language_label(F.lit(x))) for x in ("JavaScript", "TypeScript", "Go", "Ruby", "", None)] == ["J", "TS", "Go", "RU", "?", "?"]
    dates = lambda a, b: one(spark, overview.range_text(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert [dates("2024-01-01", "2024-02-01"), dates("2024-01-01", "2024-01-01"), dates(None, "2024-02-01"), dates(None, None)] == ["2024-01-01 to 2024-02-01", "2024-01-01", "2024-02-01", "-"]
    assert one(spark, overview.failure_reason(F.lit("x " * 200))) == ("x " * 200)[:177] + "..." and one(spark, overview.failure_reason(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, overview.state_text(F.lit(False), F.lit("deleted"))) == "no longer there" and one(spark, overview.state_text(F.lit(None).cast("boolean"), F.lit("renamed"))) == "there, renamed"


def test_ranges(spark):
    df = spark.createDataFrame([(1, "2024-01-31"), (2, "2024-02-01"), (3, "bad"), (4, None), (5, "2024-03-01")], "id int, day string")
    ids = lambda *ends: {r["id"] for r in overview.in_range(df, "day", *ends).collect()}
    assert ids() == {1, 2, 5} and ids(F.to_date(F.lit("2024-02-01"))) == {2, 5} and ids(None, F.to_date(F.lit("2024-02-01"))) == {1, 2}
    assert one(spark, overview.since("3m", F.to_date(F.lit("2024-05-31")))) == dt.date(2024, 2, 29)


def test_directories_and_languages(spark):
    files = spark.createDataFrame([("r", "src/a.py", "Python"), ("r", "src/b.go", "Go"), ("r", ".git/x", None), ("r", "top.md", "Unknown"), ("r", "docs/x", "Python")], "repo_id string, file_path string, language string")
    assert [(r["directory"], r["file_count"]) for r in overview.visible_directories(files).orderBy("place").collect()] == [("src", 2), ("docs", 1)]
    listed = spark.createDataFrame([("r", "src"), ("r", "gone")], "repo_id string, directory string")
    assert {(r["directory"], r["file_count"]) for r in overview.with_counts(listed, files).collect()} == {("src", 2), ("gone", 0)}
    assert {(r["language"], r["file_count"], r["percent"]) for r in overview.fallback_histogram(files).collect()} == {("Python", 2, 67), ("Go", 1, 33)}


def test_precedence(spark):
    modules = spark.createDataFrame([("a", "config", ["c/x.yml", None]), ("b", "model", ["m"]), ("b", "config", None)], "repo_id string, module_type string, files array<string>")
    changed = spark.createDataFrame([("a", "z.ini"), ("b", "config/y.php"), ("b", "src/q.go")], "repo_id string, file_path string")
    assert {(r["repo_id"], r["file_path"], r["part"]) for r in overview.config_files(modules, changed).where("file_path is not null").collect()} == {("a", "c/x.yml", 0), ("b", "config/y.php", 1)}
    commands = spark.createDataFrame([("a", 1, 0, "make"), ("a", 0, 2, "npm run dev")], "repo_id string, part int, ordinal int, command string")
    languages = spark.createDataFrame([("a", "Go", 3), ("b", "Go", 3), ("b", "PHP", 3), ("c", "COBOL", 1)], "repo_id string, language string, file_count long")
    assert {(r["repo_id"], r["command"]) for r in overview.start_command(commands, languages).collect()} == {("a", "npm run dev"), ("b", "go run ."), ("c", "-")}
