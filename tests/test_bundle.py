from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from custodia import bundle
from custodia.operators import authors, history, inventory, structure
from custodia.plans import catalog
from custodia.rules.structure import RULES


def test_analysis_and_documents(spark, data, tmp_path):
    parts = bundle.analyze(spark, data, ["languages", "commits"])
    assert set(parts) == {"languages", "commits"} and parts["languages"].count() > 0
    assert set(bundle.PARTS.values()) <= set(catalog.ALL)
    bundle.render(spark, data, str(tmp_path / "md"))
    held = spark.read.parquet(str(tmp_path / "md"))
    assert held.where("name like 'handover\\\\_%.md' and value like '## %'").count() == held.count() > 0
    bundle.render(spark, data, str(tmp_path / "html"), ".html", personal=True)
    assert spark.read.parquet(str(tmp_path / "html")).where("value like '<!doctype html>%'").count() > 0
    with pytest.raises(ValueError):
        bundle.render(spark, data, str(tmp_path / "pdf"), ".pdf")


def test_languages_and_queries_can_be_added(spark):
    bundle.register_language("Nim", [("function", r"^proc ([a-z]+)")])
    bundle.register_language("Nim", [("function", r"^never")])
    try:
        df = spark.createDataFrame([(1, "r", "a.nim", "Nim", "proc go() =\n  discard\n")], "file_id long, repo_id string, file_path string, file_language string, content string")
        assert [(r["kind"], r["name"]) for r in structure.declarations(df).collect()] == [("function", "go")]
    finally:
        RULES[:] = [r for r in RULES if r.language != "Nim"]
    with pytest.raises(ValueError):
        bundle.register_query("author_profile", None)


def test_reasons_totals_and_lists_of_paths(spark):
    rows = [("r", "a", "src/auth.py", 9, 600, 1, "2024", "renamed", True, "m", "Python"), ("r", "a", "x.md", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "repo_id string, author string, file_path string, change_count long, additions long, deletions long, last_commit_date string, status string, file_exists boolean, module_name string, file_language string")
    assert {r["file_path"]: r["reasons"] for r in authors.with_reasons(df).collect()} == {"src/auth.py": ["many_changes", "many_lines", "renamed", "critical_path"], "x.md": []}
    changes = df.withColumn("hash", F.lit("h"))
    assert [tuple(r) for r in history.commit_totals(changes).collect()] == [("r", "h", 2, 600, 1)]
    files = spark.createDataFrame([("r", p) for p in (".env", "a/id_rsa", "Shop.xcodeproj/x", "src/a.py", "src/vendor/b.py", "src/c.py", ".env")], "repo_id string, file_path string")
    assert [r["file_path"] for r in inventory.sensitive_paths(files).orderBy("place").collect()] == [".env", "a/id_rsa"] and inventory.sensitive_paths(files, 1).count() == 1
    assert [r["directory"] for r in inventory.with_suffix(files, ".xcodeproj").collect()] == ["Shop.xcodeproj"]
    assert [r["file_path"] for r in inventory.first_below(files, "src").orderBy("place").collect()] == ["src/a.py", "src/c.py"]
