from __future__ import annotations

import shutil
import subprocess

import pytest

from custodia.operators import history, relations
from custodia.render.documents import document_name, html_of
from custodia.sources.git import commits_and_changes, lines_of_author, read_git
from custodia.sources.tree import read_trees
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git is missing")


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*words, who="Ann Lee", mail="ann@x.example"):
        subprocess.run(["git", "-c", f"user.name={who}", "-c", f"user.email={mail}", *words], cwd=root, check=True, capture_output=True)

    def write(name, text):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    git("init", "-b", "main")
    write("src/api/orders.ts", "export function load() {\n  return 1\n}\n" * 5)
    write("名 前.py", "x = 1\n")
    git("add", ".")
    git("commit", "-m", "first")
    (root / "src/api/orders.ts").rename(root / "src/api/client.ts")
    git("add", ".")
    git("commit", "-m", "rename", who="Bob", mail="bob@x.example")
    write("src/api/client.ts", "export function load() {\n  return 2\n}\n" + "export function load() {\n  return 1\n}\n" * 4)
    write("_partial.html", "a")
    write(".env.example", "A=1")
    write("node_modules/x/y.js", "z")
    git("add", "-f", ".")
    git("commit", "-m", "change")
    git("branch", "dev")
    return str(root)


def test_log(spark, repository):
    commits, changes, stats = commits_and_changes(read_git(spark, {"r": repository}))
    rows = {r["message"]: r for r in commits.collect()}
    assert [rows[m]["commit_seq"] for m in ("first", "rename", "change")] == [1, 2, 3]
    assert rows["rename"]["author_email"] == "bob@x.example"
    listed = {(r["status"], r["file_path"], r["previous_path"]) for r in changes.collect()}
    assert ("renamed", "src/api/client.ts", "src/api/orders.ts") in listed and ("added", "名 前.py", None) in listed
    counted = {r["file_path"]: (r["additions"], r["deletions"]) for r in history.with_line_stats(changes.where("status <> 'renamed'"), stats).collect()}
    assert counted["src/api/client.ts"] == (1, 1) and counted["名 前.py"] == (1, 0)


def test_authors_branches_and_blame(spark, repository):
    assert {(r["name"], r["commit_count"]) for r in read_git(spark, {"r": repository}, "authors").collect()} == {("Ann Lee", 2), ("Bob", 1)}
    assert {(r["branch"], r["current"]) for r in read_git(spark, {"r": repository}, "branches").collect()} == {("main", True), ("dev", False)}
    blame = read_git(spark, {"r": repository}, "blame", paths="src/api/client.ts")
    text = lines_of_author(blame, "ANN@x.example").first()["text"].split("\n")
    assert len(text) == 15 and text[1] == "  return 2"
    assert set(lines_of_author(blame, "nobody").first()["text"]) == {"\n"}


def test_tree_keeps_hidden_names_and_prunes(spark, repository):
    rows = {r["file_path"]: r for r in read_trees(spark, {"r": repository}).collect()}
    assert {"_partial.html", ".env.example", "名 前.py", "src/api/client.ts"} <= set(rows) and "node_modules/x/y.js" not in rows
    assert rows["_partial.html"]["content"] == "a"
    assert "node_modules/x/y.js" in {r["file_path"] for r in read_trees(spark, {"r": repository}, pruned=False, content=False).collect()}


def test_imports_and_calls(spark):
    files = spark.createDataFrame([("r", "src/a.ts", "TypeScript", "import { b } from './lib';\nimport x from '../y/Z.js';\nimport r from 'react';\nm.run(1)\nexport function go() {\n"), ("r", "src/lib/index.ts", "TypeScript", "function run() {\n"), ("r", "y/z.js", "JavaScript", "function other() {\n")], "repo_id string, file_path string, file_language string, content string")
    imported = relations.imports(files)
    assert {(r["import_path"], r["to_file"]) for r in relations.resolved_imports(imported, files).collect()} == {("./lib", "src/lib/index.ts"), ("../y/Z.js", "y/z.js")}
    assert {(r["call"], r["to_file"]) for r in relations.call_edges(relations.calls(files), relations.symbols(files)).collect()} == {("run", "src/lib/index.ts")}


def test_html(spark):
    page = html_of("# A <b>\n- `x` **y**\n1. z\n> q\n```\n<raw>\n```\ntext", "t")
    for part in ("<h1>A &lt;b&gt;</h1>", "<ul>\n<li><code>x</code> <strong>y</strong></li>\n</ul>", "<ol>\n<li>z</li>\n</ol>", "<blockquote>q</blockquote>", "&lt;raw&gt;", "<p>text</p>"):
        assert part in page
    assert spark.range(1).select(document_name(F.lit("a/b c"), ".md").alias("n")).first()["n"] == "handover_a_b_c.md"
