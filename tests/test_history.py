from __future__ import annotations

import random

import pytest

from custodia.operators import history

CHANGES = "repo_id string, author string, hash string, commit_seq long, change_idx int, status string, file_path string, previous_path string, short_hash string, commit_date string, message string"


def oracle(rows):
    """The fold of one author at a time, in plain Python, written for this test only."""
    out = {}
    for repo, author in {r[:2] for r in rows}:
        files = {}
        for r in sorted((r for r in rows if r[:2] == (repo, author)), key=lambda r: (r[3], r[2], r[4])):
            status, path, before = r[5:8]
            if status == "renamed" and before in files and before != path:
                moved = files.pop(before)
                files.pop(path, None)
                files[path] = {**moved, "before": moved["before"] or before}
            held = files.setdefault(path, {"n": 0, "before": before if status == "renamed" else None, "status": "other"})
            held["n"] += 1
            old = held["status"]
            held["status"] = old if old == status else status if old == "other" else "deleted" if status == "deleted" else "renamed" if "renamed" in (old, status) else "added" if (old, status) == ("modified", "added") else old
        out |= {(repo, author, p): (f["n"], f["before"], f["status"]) for p, f in files.items()}
    return out


def folded(spark, rows):
    df = spark.createDataFrame(rows, CHANGES)
    return {(r["repo_id"], r["author"], r["file_path"]): (r["change_count"], r["previous_path"], r["status"]) for r in history.rename_fold(df).collect()}


def row(seq, status, path, before=None, author="a", repo="r", idx=0):
    return (repo, author, f"h{seq}", seq, idx, status, path, before, f"s{seq}", f"2024-01-{seq:02d}", "m")


def test_chain_of_renames(spark):
    rows = [row(1, "added", "a"), row(2, "renamed", "b", "a"), row(3, "modified", "b"), row(4, "renamed", "c", "b"), row(5, "renamed", "x", "c", author="other")]
    assert folded(spark, rows) == {("r", "a", "c"): (4, "a", "renamed"), ("r", "other", "x"): (1, "c", "renamed")}


def test_rename_onto_a_known_path_and_readding(spark):
    rows = [row(1, "added", "a"), row(2, "added", "b"), row(3, "renamed", "b", "a"), row(4, "deleted", "b"), row(5, "added", "b"), row(6, "added", "a")]
    assert folded(spark, rows) == {("r", "a", "b"): (4, "a", "deleted"), ("r", "a", "a"): (1, None, "added")}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_random_histories_whatever_the_partitions(spark, parts):
    random.seed(7)
    rows = []
    for seq in range(1, 400):
        status = random.choice(["added", "modified", "modified", "deleted", "renamed", "renamed", "copied", "other"])
        rows.append(row(seq, status, random.choice("abcdefgh"), random.choice("abcdefgh") if status in ("renamed", "copied") else None, random.choice("xy"), random.choice(["r", "q"]), random.randint(0, 2)))
    rows.append(row(500, "modified", "a"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert folded(spark, rows) == oracle(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_renames_and_no_rows(spark):
    assert folded(spark, [row(1, "added", "a")]) == {("r", "a", "a"): (1, None, "added")}
    assert folded(spark, []) == {}


def test_log_lines(spark):
    lines = spark.createDataFrame([("h\x1fs\x1fAnn\x1fa@x\x1f2024-01-01\x1fone\x1ftwo",), ("short",)], "value string")
    assert [tuple(r) for r in history.commit_headers(lines).collect()] == [("h", "s", "Ann", "a@x", "2024-01-01", "one\x1ftwo")]
    status = spark.createDataFrame([("R100\told name.py\tnew.py",), ("C\tonly.py",), ("M\t/a\\b.py",), ("X",), ("T\tt.py",)], "value string")
    assert {(r["status"], r["file_path"], r["previous_path"]) for r in history.name_status(status).collect()} == {("renamed", "new.py", "old name.py"), ("copied", "only.py", None), ("modified", "a/b.py", None), ("other", "t.py", None)}
    stats = spark.createDataFrame([("3\t4\tsrc/{a => b}/x.py",), ("-\t-\tlogo.png",), ("bad",)], "value string")
    assert {(r["additions"], r["deletions"], r["file_path"]) for r in history.line_stats(stats).collect()} == {(3, 4, "src/b/x.py"), (0, 0, "logo.png")}


def test_line_counts_by_path_previous_path_and_ending(spark):
    changes = spark.createDataFrame([("r", "h", 0, "modified", "a/x.py", None), ("r", "h", 1, "renamed", "b.py", "old.py"), ("r", "h", 2, "modified", "deep/z.py", None), ("r", "h", 3, "added", "none.py", None)], "repo_id string, hash string, change_idx int, status string, file_path string, previous_path string")
    stats = spark.createDataFrame([("r", "h", 0, "a/x.py", 1, 1), ("r", "h", 1, "old.py", 2, 2), ("r", "h", 2, "z.py", 3, 3), ("r", "h", 3, "q/deep/z.py", 9, 9)], "repo_id string, hash string, stat_idx int, stat_path string, additions long, deletions long")
    assert {(r["file_path"], r["additions"]) for r in history.with_line_stats(changes, stats).collect()} == {("a/x.py", 1), ("b.py", 2), ("deep/z.py", 3), ("none.py", 0)}


def test_statuses_by_blocks_of_commits(spark):
    random.seed(9)
    codes = ["added", "modified", "deleted", "renamed", "copied", "other"]
    rows = [("r", f"a{k % 3}", f"p{k % 4}", k, f"h{k}", 0, random.choice(codes), f"d{k}", f"s{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "repo_id string, author string, file_path string, commit_seq long, hash string, change_idx int, status string, commit_date string, short_hash string")
    got = [sorted(map(tuple, history.file_profiles(df, block).collect())) for block in (1, 7, 10_000)]
    assert got[0] == got[1] == got[2]
    wanted = {}
    for repo, author, path, _, _, _, status, date, short in rows:
        held = wanted.setdefault((repo, author, path), ["other", 0, date, None, None])
        held[0] = history._merged(held[0], status)
        held[1] += 1
        held[3:] = date, short
    rows = {(r["repo_id"], r["author"], r["file_path"]): [r["status"], r["change_count"], r["first_date"], r["last_date"], r["last_hash"]] for r in history.file_profiles(df, 7).collect()}
    assert rows == wanted
