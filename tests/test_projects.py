from __future__ import annotations

import datetime as dt

from custodia.functions.bodies import body_from
from custodia.operators import projects
from custodia.sources.store import SCHEMA, read_projects, with_project, without_project


def test_start_commands_and_managers(spark):
    files = [
        ("r", "package.json", '{"scripts": {"build": "b", "dev": "d", "zzz": "z"}, "dependencies": {"a": "1"}}'), ("r", "web/package.json", '{"scripts": {"start": "s"}}'), ("r", "web/pnpm-lock.yaml", ""), ("r", "web/yarn.lock", ""),
        ("r", "manage.py", ""), ("q", "package.json", "broken"), ("q", "go.mod", "module q\n"), ("q", "x/go.mod", None),
    ]
    df = spark.createDataFrame(files, "repo_id string, file_path string, content string")
    assert {(r["file_path"], r["manager"], r["dependencies"]) for r in projects.manifests(df).where("repo_id = 'r'").collect()} == {("package.json", "npm", 1), ("web/package.json", "pnpm", 0)}
    assert [r["command"] for r in projects.start_commands(df).where("repo_id = 'r'").orderBy("part", "ordinal", "command").collect()] == ["npm run dev", "cd web && pnpm start", "npm run build", "python manage.py runserver"]
    assert [r["command"] for r in projects.start_commands(df).where("repo_id = 'q'").collect()] == ["go run ."]


def test_bodies():
    assert body_from("f() { a('}') // }\n /* } */ { b } } rest", 0) == "{ a('}') // }\n /* } */ { b } }"
    assert body_from("f() { a", 0) == "{ a"
    assert body_from("f();", 0) == ""
    assert body_from("x { y } f() { z }", 8) == "{ z }"


def test_store(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    held = spark.createDataFrame([("/a", "a", "Go", None, day(1)), ("/b", "b", "Go", None, day(2))], SCHEMA)
    new = spark.createDataFrame([("/a", "a2", "Go", "x.md", day(3)), ("/a", "old", "Go", None, day(1))], SCHEMA)
    merged = with_project(held, new)
    assert [(r["path"], r["name"]) for r in merged.collect()] == [("/a", "a2"), ("/b", "b")]
    assert [r["path"] for r in with_project(held, new, 1).collect()] == ["/a"]
    assert [r["path"] for r in without_project(merged, "/a").collect()] == ["/b"]
    assert read_projects(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert read_projects(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "good.json").write_text('[{"path": "/a", "name": "a"}, {"path": "/b"}]')
    assert read_projects(spark, str(tmp_path / "good.json")).count() == 2
