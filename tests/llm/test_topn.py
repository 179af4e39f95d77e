from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from custodia.llm.topn import LoserTree, merge_runs, top_n_per_group

SCHEMA = "who string, path string, repo string, n long, g string, s long, bucket int, run int"


def brute(rows, n):
    groups = {}
    for who, path, repo, count, *_ in set(rows):
        if None not in (who, path, repo, count):
            groups.setdefault(who, set()).add((-count, path, repo))
    return sorted((g, p, r, -c) for g, keys in groups.items() for c, p, r in sorted(keys)[:n])


def run(spark, rows, n=3, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = top_n_per_group(df, F.col("who"), "n", ["path", "repo"], n, **options)
    return sorted((r["group_key"], r["path"], r["repo"], r["n"]) for r in out.collect())


def test_loser_tree_merges_any_number_of_runs():
    random.seed(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((random.randint(0, 9),) for _ in range(random.randint(0, 6))) for _ in range(k)]
        tree, out = LoserTree(runs), []
        while (key := tree.top()) is not None:
            out.append(key)
            tree.move(tree.winner, tree.at[tree.winner] + 1)
        assert out == sorted(x for run in runs for x in run)


def test_merge_seeks_past_a_full_group():
    runs = [[("a", -i, "", "", "") for i in range(50, 0, -1)] + [("b", 0, "", "", "")], [("a", -60, "", "", ""), ("ab", 1, "", "", "")]]
    assert [(k[0], k[1]) for k in merge_runs(runs, 2)] == [("a", -60), ("a", -50), ("ab", 1), ("b", 0)]


@pytest.mark.parametrize("run_rows", [7, 10_000])
def test_same_as_brute_force_with_ties_nulls_repeats_and_a_hot_group(spark, run_rows):
    random.seed(2)
    pick = lambda xs: random.choice(xs)
    rows = [(pick(["hot"] * 4 + ["a", "b", "", "é", "zz", None]), pick(["x", "y", "Z", "a/b", None, "", "中"]), pick(["r1", "r2"]), pick([1, 1, 2, 3, -5, None]), "clash", 1, 2, 3) for _ in range(400)]
    rows += rows[:50]
    assert run(spark, rows, 3, run_rows=run_rows) == brute(rows, 3)


def test_empty_table_and_small_groups(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "p", "r", 1, None, None, None, None)], 10) == [("a", "p", "r", 1)]


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        top_n_per_group(df, F.col("who"), "n", [], 3)
    with pytest.raises(ValueError):
        top_n_per_group(df, F.col("who"), "n", ["path"], 0)
